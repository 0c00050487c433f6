"""Who speaks: one reading of a message's role, used wherever roles are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of a speaker's role, after trimming and lower-casing.
USER_ROLES = ["user", "usuario", "usuaria", "human", "humano", "humana", "cliente", "customer", "person", "persona", "prompter", "utilisateur", "usuário"]
ASSISTANT_ROLES = ["assistant", "asistente", "bot", "chatbot", "ai", "ia", "model", "modelo", "gpt", "agent", "agente", "assistente"]
NOTE_ROLES = ["system", "sistema", "tool", "herramienta", "tools", "function", "función", "developer", "système", "ferramenta"]

USER, ASSISTANT, UNREADABLE = 0, 1, 2


def speaker(role: Column) -> Column:
    """0 user, 1 assistant, 2 unreadable (null too); null for notes of the system or of tools."""
    r = F.lower(F.regexp_replace(F.coalesce(role, F.lit("")), r"(?U)^[\s\p{Cf}]+|[\s\p{Cf}]+$", ""))
    return F.when(r.isin(USER_ROLES), USER).when(r.isin(ASSISTANT_ROLES), ASSISTANT).when(~r.isin(NOTE_ROLES), UNREADABLE)


def said_by(role: Column, who: int) -> Column:
    """True or false, never null."""
    return F.coalesce(speaker(role) == who, F.lit(False))
