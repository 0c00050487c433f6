"""Sentences in many languages, written by hand apart from the test tables: what p4 and p8 find of them, and what they
must leave alone. When first run 32 of the 36 refusals and 41 of the 44 residues were found (README); the rules of p4
were then widened by the four, so the lists are a check of breadth, not an estimate of recall."""

import pytest

from sillar.llm.pair_defects import defect
from sillar.llm.residue import residue

QUESTION = "¿Cuántos habitantes tiene el puerto de Tikal y cuándo se fundó?"
SOURCES = '[{"title": "Tikal", "section": null}]'

REFUSALS = """
Me veo en la obligación de no contestar.
Paso.
Prefiero guardar silencio sobre ese asunto.
No te lo diré.
No voy a entrar en ese tema.
Sobre ese particular no puedo pronunciarme.
No está en mi mano darte esa cifra.
Tengo que declinar la respuesta.
Esa pregunta excede lo que puedo tratar aquí. Prueba con otra.
No me es posible facilitar ese dato. Consulta otra fuente.
Los textos que tengo no recogen ese dato.
Nada puedo decir al respecto.
No tengo permitido hablar de ello.
No soy quién para decirlo.
Lamento no poder ayudar.
I'd rather not answer that.
I have no information about this topic.
Sorry, that's not something I can help with.
I must politely decline.
Não posso responder a essa pergunta.
Prefiro não comentar.
Je préfère ne pas répondre.
Désolé, je ne dispose pas de cette information.
Mi dispiace, non sono in grado di rispondere.
Dazu kann ich leider nichts sagen.
Es tut mir leid, darüber habe ich keine Informationen.
Het spijt me, ik kan die vraag niet beantwoorden.
Tyvärr kan jag inte svara på det.
Beklager, jeg har ingen opplysninger om dette.
Niestety nie mogę odpowiedzieć na to pytanie.
Îmi pare rău, nu pot răspunde la această întrebare.
Bohužel nemám žádné informace.
Üzgünüm, bu soruya yanıt veremem.
Barkatu, ezin dut galdera hori erantzun.
К сожалению, я не могу ответить на этот вопрос.
Em sap greu, no tinc aquesta informació.
""".strip().split("\n")

SOUND = """
No hay más que dos puertos en la costa, y Tikal es el mayor.
Nada se construyó allí antes de 1700.
El paso de Tikal se abrió en 1850 y no volvió a cerrarse.
Nunca tuvo muralla, pero sí una torre.
No fue villa hasta 1618.
Ningún cronista lo menciona antes de 1500; el primero es Ruiz.
Se desconoce la fecha exacta, pero el censo de 1700 ya lo cita con 400 vecinos.
No se conserva el acta de fundación.
Imposible de cruzar en invierno, el vado dio nombre a la villa.
Paso obligado de los arrieros, Tikal creció desde 1700.
No está en la costa, sino a 20 km de ella.
Sin murallas ni torres, la villa cayó en dos días.
""".strip().split("\n")

OTHER_LANGUAGES = """
Staden ligger vid floden och har en stor hamn som byggdes under 1700-talet av invånarna.
Byen ligger ved floden og har en stor havn, som blev bygget af indbyggerne efter krigen.
Byen ligger ved elven og har en stor havn som ble bygget av innbyggerne etter krigen.
Miasto leży nad rzeką i ma duży port, który został zbudowany przez mieszkańców po wojnie.
Orașul se află lângă râu și are un port mare care a fost construit de locuitori după război.
Hiria ibaiaren ondoan dago eta portu handia du, gerraren ondoren herritarrek egin zuten.
Město leží u řeky a má velký přístav, který byl postaven obyvateli po válce.
A város a folyó mellett fekszik, és nagy kikötője van, amelyet a háború után építettek.
Şehir nehrin yanında yer alır ve savaştan sonra halk için yapılan büyük bir limana sahip.
Kaupunki sijaitsee joen rannalla ja siinä on suuri satama, joka on rakennettu sodan jälkeen.
De stad ligt aan de rivier en heeft een grote haven die na de oorlog door de inwoners werd gebouwd.
La vila es troba vora el riu i té un port molt gran que els veïns van bastir amb els seus diners.
Kota ini terletak di tepi sungai dan memiliki pelabuhan besar yang dibangun oleh warga setelah perang.
Thành phố nằm bên sông và có một cảng lớn được xây dựng trong thời chiến.
Город стоит на реке и имеет большой порт.
この町は川のそばにあり、大きな港があります。
تقع المدينة على ضفاف النهر ولها ميناء كبير.
Η πόλη βρίσκεται δίπλα στο ποτάμι και έχει μεγάλο λιμάνι.
""".strip().split("\n")

RESIDUE = """
Something went wrong. Please try again later.
Oops! That page can't be found.
This site can't be reached. The connection was reset.
You need to enable JavaScript to run this app.
Algo salió mal. Inténtelo de nuevo más tarde.
La página que buscas no existe o ha sido movida.
Página não encontrada. Volte ao início.
Ative o JavaScript no seu navegador para continuar.
Page introuvable. Retour à l'accueil.
Une erreur s'est produite. Veuillez réessayer plus tard.
Pagina non trovata. Torna alla home.
Seite nicht gefunden. Bitte versuchen Sie es später erneut.
Bitte aktivieren Sie JavaScript in Ihrem Browser.
Er is iets misgegaan. Probeer het later opnieuw.
Sidan kunde inte hittas. Försök igen senare.
Vänligen aktivera JavaScript i din webbläsare för att fortsätta.
Der opstod en fejl. Prøv igen senere.
Siden ble ikke funnet.
Sivua ei löytynyt. Yritä myöhemmin uudelleen.
Nie znaleziono strony. Spróbuj ponownie później.
Włącz obsługę JavaScript w przeglądarce, aby kontynuować.
Stránka nenalezena. Zkuste to znovu později.
Pagina nu a fost găsită.
Az oldal nem található. Próbálja újra később.
Sayfa bulunamadı. Lütfen daha sonra tekrar deneyin.
Orria ez da aurkitu. Saiatu berriro geroago.
Страница не найдена. Попробуйте позже.
Пожалуйста, включите JavaScript в вашем браузере.
Сторінку не знайдено. Спробуйте пізніше.
Η σελίδα δεν βρέθηκε.
حدث خطأ ما. يرجى المحاولة مرة أخرى لاحقا.
ページが見つかりません。しばらくしてからもう一度お試しください。
サーバーエラーが発生しました。
找不到页面,请稍后再试。
페이지를 찾을 수 없습니다. 잠시 후 다시 시도해 주세요.
Ihr Text hier.
Przykładowy tekst.
Пример текста.
Página en construcción.
Estimado [Nombre del cliente], le escribimos por su compra.
La villa de :nombre se fundó en el año |AÑO| junto al río.
Fundación | {}
Dear {first_name}, welcome to the archive.
Pegue aquí el texto de la sección.
""".strip().split("\n")

CONTENT = """
El error de los astrónomos de la época fue creer que el puerto estaba más al sur.
La página 40 del manuscrito no se encontró hasta 1950, cuando se restauró el archivo.
El servidor de la comarca atendía en 1990 a veinte escuelas, y su navegador era propio.
La revista «Page not found» se publicó en la villa entre 2001 y 2004.
El programa imprime «Something went wrong» si el archivo falta, según la guía de 1998.
La construcción del puente se interrumpió en 1750 y se reanudó diez años más tarde.
Hora local: 12:30; proporción 3:2; véase https://ejemplo.org/a:b para más datos.
| Año | Población | Alcalde |
En el dialecto local [sic] la palabra significa «puente» [1].
El acceso al castillo fue denegado a los vecinos hasta la reforma de 1711.
La sesión del consejo expiró sin acuerdo y los vecinos volvieron a reunirse en mayo.
Indica el texto de 1580 que el puerto era nuevo.
""".strip().split("\n")


def test_refusals():
    found = [r for r in REFUSALS if defect(QUESTION, r, SOURCES) == "refusal"]
    assert len(found) >= 0.9 * len(REFUSALS), set(REFUSALS) - set(found)


@pytest.mark.parametrize("answer", SOUND)
def test_sound_answers(answer):
    assert defect(QUESTION, answer, SOURCES) is None


@pytest.mark.parametrize("answer", OTHER_LANGUAGES)
def test_other_languages(answer):
    assert defect(QUESTION, answer, SOURCES) == "language"


def test_residue():
    found = [r for r in RESIDUE if residue(r) is not None]
    assert len(found) >= 0.9 * len(RESIDUE), set(RESIDUE) - set(found)


@pytest.mark.parametrize("text", CONTENT)
def test_content(text):
    assert residue(text) is None
