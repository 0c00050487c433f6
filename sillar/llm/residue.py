"""Template residue and error-page text.

Finds documents that hold unfilled template fields or filler in the place of
content, or that consist of an error message or of a notice that scripts are
required.

Phrases of errors, filler and script notices in several languages are found in
one pass of a multi-pattern automaton over the text without case and accents. A
sentence counts as such if the phrases cover enough of it, a document if such
sentences cover enough of the document. The beginnings of unfilled fields are found
by a second automaton, over the text as it is written, and their forms are tried
there; a marker or phrase inside a quotation, or after a word that speaks of
it ("the variable {name}"), is a mention and does not count.

The operator is one pass over whole texts, each row for itself. Nothing is shuffled, but where
the table comes in fewer pieces than there are cores its texts are dealt out once.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sillar.llm.plaintext import plain
from sillar.session import spread

TEMPLATE, FILLER, ERROR = "template", "filler", "error"

# ---------------------------------------------------------------- phrases

# Fixed values. STRONG: what an error or a notice says. WEAK: what stands around it.
STRONG = """
error|error interno|codigo de error|error inesperado|se ha producido un error|ha ocurrido un error|fatal error|erro interno|erreur|fehler|errore|exception|traceback|stack trace|null pointer|undefined variable|warning:|segmentation fault|err_connection_reset|err_connection_refused|err_name_not_resolved|err_timed_out|lock wait timeout|query was aborted|too many open handles|database connection failed|connection refused|connection reset
nao encontrada|nao encontrado|introuvable|nicht gefunden|non trovata|acesso negado|acces refuse|zugriff verweigert|http/1.0|http/1.1|http/2|http 4|http 5|bad request|unauthorized|forbidden|not found|method not allowed|request timeout|too many requests|internal server error|not implemented|bad gateway|service unavailable|gateway timeout|access denied|permission denied
solicitud incorrecta|no autorizado|prohibido|no encontrada|no encontrado|demasiadas peticiones|demasiadas solicitudes|error interno del servidor|puerta de enlace incorrecta|puerta de enlace no valida|servicio no disponible|tiempo de espera agotado|tiempo agotado|acceso denegado|no tiene permiso|no tienes permiso|pagina no encontrada|no existe el articulo solicitado|respuesta vacia
no se pudo|no se puede|no se ha podido|no fue posible|no ha sido posible|no es posible|imposible|fallo al|fallo en|problema al|ha fallado|unable to|could not|cannot|can't|failed to|nao foi possivel|impossivel|impossible de|konnte nicht|impossibile
ha cambiado o ya no existe|ya no existe|ha sido eliminada|ha sido eliminado|eliminada o movida|pode ter sido removida|a ete supprimee|has been removed|has been deleted|has moved|mantenimiento programado|en mantenimiento|under maintenance|scheduled maintenance|sesion ha caducado|sesion ha expirado|session has expired|limite de consultas|rate limit|ha sido bloqueada|ha sido bloqueado|has been blocked|cortafuegos|firewall|conexion con la base de datos|algunas funciones|no se cargaran|no disponible|not available|indisponible
javascript|java script|scripts|codigo js|motor de scripts|secuencias de comandos|ejecucion de scripts|noscript|<noscript|active content
active|activar|activado|habilite|habilitar|habilitado|encienda|encender|permita|permitir|autorice|autorizar|hace falta|falta activar|es necesario|necesita|debe permitir|requiere|desactivado|bloqueado|bloqueados|no admite|no puede iniciarse|enable|enabled|turn on|allow|allowed|requires|required|disabled|ative|ativar|e necessario|veuillez|activer|activez|aktivieren|abilitare|attivare
""".replace("\n", "|").strip("|").split("|")

WEAK = """
vuelva a intentarlo|vuelve a intentarlo|intentelo de nuevo|intentelo mas tarde|dentro de unos minutos|please try again|try again later|espera|espere|segundos|seconds|inicie sesion|inicia sesion|de nuevo|log in|sign in|si el problema continua|si el problema persiste|avise|administracion del sitio|administrador|administrator|contact|contacte|identificador de la peticion|request id|referencia|nginx|apache|cloudflare|varnish|volver a la portada|volver al inicio|portada|ayuda|contacto|inicio|home|help
loading|please wait|cargando|un momento|just a moment|verificando que no es un robot|verificando|no es un robot|robot|captcha|recargue|recargar|reload|refresh|use una version reciente|version reciente|de su navegador|en su navegador|navegador|browser|navigateur|compruebe|tambien que acepta|acepta las cookies|cookies|bloqueador de anuncios|desactive|ad blocker|despues|por favor|please|sorry|lo sentimos|disculpe|vaya|ups|oops|atencion|aviso
la pagina|esta pagina|the page|this page|the requested|a pagina|cette page|pagina|page|el articulo|este articulo|article|this article|articulo solicitado|contenido dinamico|el contenido|este contenido|contenido|content|la vista|la cache|la revision|el visor|del articulo|el archivo|archivo de plantilla|en la linea|at line|on line|la fila|de la tabla|variable title|el recurso|al cargar|cargar|cargado|abrir|leer|generar|recuperar|contactar|mostrar|mostrarse|establecer|continuar|para continuar|to continue|pour afficher|para ver|to view|antes de seguir|ejecucion|configuracion|en la configuracion|en este dominio|este sitio|su sitio|la wiki|consultar la wiki|si quiere|algunas funciones de la wiki|de la wiki|el servidor|del servidor|su peticion|peticion|base de datos|la conexion|conexion|database|server|handles|you need to|you are looking for|could not be|be displayed|be loaded|loaded|load|displayed|script|scripts are|once|codigo|direccion que busca|la direccion|bien escrita|esta bien|en este momento|at this time|now|unavailable|por su autor|por el|la|los|las|el|en|de|su
""".replace("\n", "|").strip("|").split("|")

# The same in further languages, in their own spelling: what is strong, what is weak.
FURTHER = {
    "en": ("something went wrong|an error occurred|an unexpected error|page not found|this page doesn't exist|this page does not exist|page can't be reached|page isn't working|this site can't be reached|server error|site is down|temporarily unavailable|no longer available|link is broken|broken link|connection timed out|your connection was interrupted|account suspended|you don't have permission|cookies are disabled|browser is not supported|unsupported browser|without javascript|javascript is disabled|javascript is required|needs javascript|checking your browser|verify you are human|are you a robot|unusual traffic|quota exceeded|request could not be processed|invalid request|session expired|maintenance",
           "we're sorry|we are sorry|please|refresh the page|go back|return to the homepage|homepage|contact support|if the problem persists|the link you followed|may have been|to access|on this server|we're working on it|back soon|this website|this site|web page|your browser|to use|to continue|to work|in your|it looks like|we couldn't find|the page you requested|the page you are looking for|the|a|an|of|or|and|is|was|has|that|you|we|it|to|in|for"),
    "es": ("algo salió mal|algo ha salido mal|ha habido un error|ocurrió un error|error de servidor|error del servidor|error de conexión|página en mantenimiento|sitio en mantenimiento|enlace roto|el enlace no funciona|cuenta suspendida|navegador no compatible|cookies desactivadas|sin javascript|contenido no disponible|no se encuentra disponible|no encontramos la página|no se encontró la página|la página que busca|verifique que es humano|compruebe que no es un robot|tráfico inusual|cuota superada|solicitud no válida|sesión expirada", "actualice la página|regrese al inicio|estamos trabajando en ello|volvemos pronto|sentimos las molestias|intente de nuevo|inténtelo|un error|que|no|se|y|o|en|a|para|con|su|este|esta|ha|es"),
    "pt": ("página não encontrada|algo deu errado|ocorreu um erro|erro inesperado|erro no servidor|erro do servidor|serviço indisponível|temporariamente indisponível|acesso negado|em manutenção|ative o javascript|habilite o javascript|javascript está desativado|javascript desabilitado|seu navegador não suporta|não foi possível carregar|a página não existe|sessão expirou|tempo esgotado|muitas solicitações", "tente novamente|mais tarde|por favor|seu navegador|voltar ao início|a página que procura|esta página|este site|no|do|da|para|que|o|a|em|neste|foi|continuar|desculpe"),
    "fr": ("page introuvable|page non trouvée|une erreur est survenue|une erreur s'est produite|erreur inattendue|erreur interne|erreur du serveur|service indisponible|temporairement indisponible|accès refusé|accès interdit|en maintenance|activer javascript|activez javascript|javascript est désactivé|votre navigateur ne supporte pas|ne prend pas en charge|délai dépassé|délai d'attente dépassé|session expirée|session a expiré|trop de requêtes|n'existe pas|n'existe plus|impossible d'afficher", "veuillez réessayer|réessayer|plus tard|s'il vous plaît|veuillez|votre navigateur|retour à l'accueil|la page que vous cherchez|la page demandée|cette page|ce site|de|du|la|le|pour|dans|votre|est|désolé|oups"),
    "it": ("pagina non trovata|qualcosa è andato storto|si è verificato un errore|errore imprevisto|errore interno|errore del server|servizio non disponibile|temporaneamente non disponibile|accesso negato|in manutenzione|abilita javascript|attivare javascript|attiva javascript|javascript è disabilitato|il tuo browser non supporta|tempo scaduto|sessione scaduta|troppe richieste|non esiste più|impossibile caricare", "riprova più tardi|riprova|riprovare|per favore|il tuo browser|torna alla home|la pagina che cerchi|la pagina richiesta|questa pagina|questo sito|per|di|la|il|nel|è|continuare|spiacenti|ops"),
    "de": ("seite nicht gefunden|etwas ist schiefgelaufen|ein fehler ist aufgetreten|unerwarteter fehler|interner serverfehler|interner fehler|serverfehler|dienst nicht verfügbar|vorübergehend nicht verfügbar|nicht verfügbar|zugriff verweigert|zugriff nicht erlaubt|wartungsarbeiten|wird gewartet|javascript aktivieren|aktivieren sie javascript|javascript ist deaktiviert|ihr browser unterstützt|zeitüberschreitung|sitzung abgelaufen|sitzung ist abgelaufen|zu viele anfragen|existiert nicht|konnte nicht geladen werden|konnte nicht gefunden werden", "bitte versuchen sie es|bitte|später erneut|später|noch einmal|in ihrem browser|ihrem browser|zur startseite|die angeforderte seite|die gesuchte seite|diese seite|um fortzufahren|die|der|das|es|um|zu|in|ist|auf|entschuldigung|leider"),
    "nl": ("pagina niet gevonden|er is iets misgegaan|er ging iets mis|er is een fout opgetreden|onverwachte fout|interne serverfout|serverfout|dienst niet beschikbaar|tijdelijk niet beschikbaar|niet beschikbaar|toegang geweigerd|in onderhoud|schakel javascript in|javascript is uitgeschakeld|javascript inschakelen|uw browser ondersteunt|sessie is verlopen|te veel verzoeken|bestaat niet|kon niet worden geladen|niet worden gevonden", "probeer het later opnieuw|probeer het|later|opnieuw|alstublieft|uw browser|je browser|terug naar de startpagina|de pagina die u zoekt|deze pagina|deze website|om|te|de|het|in|van|deze|helaas|sorry"),
    "sv": ("sidan kunde inte hittas|sidan hittades inte|något gick fel|ett fel uppstod|ett fel har uppstått|ett oväntat fel|internt serverfel|serverfel|tjänsten är inte tillgänglig|inte tillgänglig|åtkomst nekad|under underhåll|aktivera javascript|javascript är inaktiverat|javascript krävs|din webbläsare stöder inte|sessionen har gått ut|för många förfrågningar|finns inte längre|finns inte|kunde inte laddas", "försök igen senare|försök igen|vänligen|var god|din webbläsare|webbläsare|till startsidan|sidan du söker|den här sidan|denna sida|för att|att|i|på|som|se|visa|fortsätta|tyvärr|oj"),
    "da": ("siden blev ikke fundet|siden kunne ikke findes|noget gik galt|der opstod en fejl|der er opstået en fejl|uventet fejl|intern serverfejl|serverfejl|tjenesten er ikke tilgængelig|ikke tilgængelig|adgang nægtet|aktiver javascript|slå javascript til|javascript er deaktiveret|din browser understøtter ikke|for mange forespørgsler|findes ikke|kunne ikke indlæses", "prøv igen senere|prøv igen|venligst|din browser|til forsiden|siden du leder efter|denne side|for at|at|i|på|som|se|vise|fortsætte|desværre|ups"),
    "no": ("siden ble ikke funnet|fant ikke siden|noe gikk galt|det oppstod en feil|det har oppstått en feil|uventet feil|intern serverfeil|serverfeil|tjenesten er ikke tilgjengelig|ikke tilgjengelig|ingen tilgang|aktiver javascript|slå på javascript|javascript er deaktivert|nettleseren din støtter ikke|for mange forespørsler|finnes ikke|kunne ikke lastes", "prøv igjen senere|prøv igjen|vennligst|nettleseren din|nettleser|til forsiden|siden du leter etter|denne siden|for å|å|i|på|som|se|vise|fortsette|dessverre|oi"),
    "fi": ("sivua ei löytynyt|sivua ei löydy|jokin meni pieleen|jotain meni pieleen|tapahtui virhe|odottamaton virhe|sisäinen palvelinvirhe|palvelinvirhe|palvelu ei ole käytettävissä|ei ole käytettävissä|pääsy estetty|pääsy kielletty|huoltokatko|ota javascript käyttöön|javascript on poistettu käytöstä|selaimesi ei tue|liian monta pyyntöä|istunto on vanhentunut", "yritä myöhemmin uudelleen|yritä uudelleen|myöhemmin|uudelleen|ole hyvä|selaimesi|selaimessasi|etusivulle|etsimääsi sivua|tämä sivu|jatkaaksesi|nähdäksesi|valitettavasti|hups"),
    "pl": ("nie znaleziono strony|strona nie została znaleziona|strona nie istnieje|coś poszło nie tak|wystąpił błąd|wystąpił nieoczekiwany błąd|nieoczekiwany błąd|wewnętrzny błąd serwera|błąd serwera|błąd|usługa niedostępna|usługa jest niedostępna|tymczasowo niedostępna|niedostępna|odmowa dostępu|brak dostępu|przerwa techniczna|prace konserwacyjne|włącz javascript|włączyć javascript|obsługę javascript|javascript jest wyłączony|przeglądarka nie obsługuje|sesja wygasła|zbyt wiele żądań|przekroczono limit|nie można załadować|nie udało się", "spróbuj ponownie później|spróbuj ponownie|spróbuj|później|ponownie|proszę|w przeglądarce|w swojej przeglądarce|twoja przeglądarka|przeglądarki|wróć na stronę główną|strona, której szukasz|ta strona|tę stronę|tej strony|aby|strony|strona|w|na|i|się|kontynuować|wyświetlić|przepraszamy|ups"),
    "cs": ("stránka nenalezena|stránka nebyla nalezena|něco se pokazilo|došlo k chybě|neočekávaná chyba|vnitřní chyba serveru|chyba serveru|služba není dostupná|nedostupná|není k dispozici|přístup odepřen|probíhá údržba|povolte javascript|zapněte javascript|javascript je vypnutý|váš prohlížeč nepodporuje|relace vypršela|příliš mnoho požadavků|neexistuje|nepodařilo se", "zkuste to znovu později|zkuste to znovu|později|prosím|ve svém prohlížeči|v prohlížeči|prohlížeč|zpět na úvod|stránka, kterou hledáte|tato stránka|tuto stránku|pro|se|v|na|a|zobrazení|pokračování|omlouváme se|jejda"),
    "ro": ("pagina nu a fost găsită|pagina nu există|ceva nu a mers bine|ceva a mers prost|a apărut o eroare|eroare neașteptată|eroare internă|eroare de server|eroare a serverului|serviciu indisponibil|temporar indisponibil|acces interzis|acces refuzat|în mentenanță|activați javascript|javascript este dezactivat|browserul dvs nu acceptă|sesiunea a expirat|prea multe cereri|nu poate fi afișată|nu a putut fi", "încercați din nou|mai târziu|vă rugăm|în browser|browserul|pagina principală|pagina pe care o căutați|această pagină|acest site|pentru|a|în|să|continua|vedea|ne pare rău|ups"),
    "hu": ("az oldal nem található|a lap nem található|valami hiba történt|hiba történt|váratlan hiba|belső szerverhiba|szerverhiba|a szolgáltatás nem elérhető|nem elérhető|hozzáférés megtagadva|karbantartás|engedélyezze a javascriptet|kapcsolja be a javascriptet|javascript le van tiltva|a böngésző nem támogatja|lejárt a munkamenet|túl sok kérés|nem létezik", "próbálja újra később|próbálja újra|később|kérjük|a böngészőben|böngészőjében|vissza a főoldalra|a keresett oldal|ez az oldal|az oldal|a|az|megtekintéséhez|folytatáshoz|sajnáljuk|hoppá"),
    "tr": ("sayfa bulunamadı|bir şeyler ters gitti|bir hata oluştu|beklenmeyen bir hata|beklenmedik bir hata|sunucu hatası|iç sunucu hatası|hizmet kullanılamıyor|geçici olarak kullanılamıyor|kullanılamıyor|erişim engellendi|erişim reddedildi|bakımdayız|bakım çalışması|javascript'i etkinleştirin|javascripti etkinleştirin|javascript devre dışı|tarayıcınız desteklemiyor|oturumunuz sona erdi|oturum süresi doldu|çok fazla istek|mevcut değil|yüklenemedi", "lütfen daha sonra tekrar deneyin|daha sonra tekrar deneyin|tekrar deneyin|lütfen|tarayıcınızda|tarayıcınız|ana sayfaya dön|aradığınız sayfa|bu sayfa|bu sayfayı|bu site|için|ve|bir|görüntülemek|devam etmek|üzgünüz|hata|ups"),
    "eu": ("orria ez da aurkitu|ez da orria aurkitu|zerbait gaizki joan da|errore bat gertatu da|ustekabeko errorea|zerbitzariaren errorea|barne errorea|zerbitzua ez dago erabilgarri|ez dago erabilgarri|sarbidea ukatuta|mantentze-lanetan|gaitu javascript|aktibatu javascript|javascript desgaituta|saioa iraungi da|ez da existitzen", "saiatu berriro geroago|saiatu berriro|geroago|mesedez|zure nabigatzailean|nabigatzailea|hasierara itzuli|bilatzen ari zaren orria|orri hau|jarraitzeko|ikusteko|barkatu"),
    "ca": ("pàgina no trobada|no s'ha trobat la pàgina|alguna cosa ha anat malament|s'ha produït un error|error inesperat|error intern del servidor|error del servidor|servei no disponible|no disponible|accés denegat|en manteniment|activeu javascript|activa javascript|habiliteu javascript|javascript està desactivat|la sessió ha caducat|massa peticions|no existeix", "torneu-ho a provar|torna-ho a provar|més tard|si us plau|el vostre navegador|navegador|torna a l'inici|la pàgina que busqueu|aquesta pàgina|per|de|la|el|al|continuar|veure|ho sentim"),
    "gl": ("páxina non atopada|non se atopou a páxina|algo saíu mal|produciuse un erro|erro inesperado|erro interno do servidor|erro do servidor|servizo non dispoñible|non dispoñible|acceso denegado|en mantemento|active javascript|javascript está desactivado|a sesión caducou|non existe", "ténteo de novo|inténteo máis tarde|máis tarde|por favor|o seu navegador|navegador|volver ao inicio|a páxina que busca|esta páxina|para|de|a|o|no|ver|continuar|sentímolo"),
    "id": ("halaman tidak ditemukan|terjadi kesalahan|kesalahan tak terduga|kesalahan server|layanan tidak tersedia|tidak tersedia|akses ditolak|dalam pemeliharaan|aktifkan javascript|javascript dinonaktifkan|browser anda tidak mendukung|sesi telah berakhir|terlalu banyak permintaan|tidak ada lagi", "silakan coba lagi nanti|coba lagi|nanti|silakan|browser anda|kembali ke beranda|halaman yang anda cari|halaman ini|situs ini|untuk|di|yang|melanjutkan|melihat|maaf"),
    "vi": ("không tìm thấy trang|trang không tồn tại|đã xảy ra lỗi|có lỗi xảy ra|lỗi máy chủ|dịch vụ không khả dụng|không khả dụng|truy cập bị từ chối|đang bảo trì|bật javascript|kích hoạt javascript|javascript bị tắt|phiên đã hết hạn|quá nhiều yêu cầu", "vui lòng thử lại sau|thử lại sau|thử lại|vui lòng|trình duyệt của bạn|trình duyệt|về trang chủ|trang bạn tìm|trang này|để|trong|của|tiếp tục|xem|xin lỗi"),
    "ru": ("страница не найдена|страница не существует|что-то пошло не так|произошла ошибка|непредвиденная ошибка|внутренняя ошибка сервера|ошибка сервера|ошибка|сервис недоступен|сервер недоступен|временно недоступен|временно недоступна|недоступна|доступ запрещён|доступ запрещен|технические работы|включите javascript|javascript отключён|javascript отключен|браузер не поддерживает|сессия истекла|слишком много запросов|не удалось загрузить|не удалось", "попробуйте позже|попробуйте ещё раз|попробуйте снова|повторите попытку позже|повторите попытку|пожалуйста|в вашем браузере|в браузере|ваш браузер|вернуться на главную|запрашиваемая страница|страница, которую вы ищете|эта страница|эту страницу|этой страницы|страница|на|в|для|чтобы|и|просмотра|продолжить|извините|упс"),
    "uk": ("сторінку не знайдено|сторінка не існує|щось пішло не так|сталася помилка|виникла помилка|внутрішня помилка сервера|помилка сервера|сервіс недоступний|тимчасово недоступний|недоступна|доступ заборонено|технічні роботи|увімкніть javascript|javascript вимкнено|сесія завершилася|забагато запитів|не вдалося", "спробуйте пізніше|спробуйте ще раз|будь ласка|у вашому браузері|в браузері|повернутися на головну|сторінка, яку ви шукаєте|ця сторінка|цю сторінку|на|у|в|для|щоб|перегляду|продовжити|вибачте"),
    "el": ("η σελίδα δεν βρέθηκε|κάτι πήγε στραβά|παρουσιάστηκε σφάλμα|απρόσμενο σφάλμα|σφάλμα διακομιστή|σφάλμα|η υπηρεσία δεν είναι διαθέσιμη|δεν είναι διαθέσιμη|δεν επιτρέπεται η πρόσβαση|ενεργοποιήστε τη javascript|ενεργοποιήστε το javascript|δεν υπάρχει", "δοκιμάστε ξανά αργότερα|δοκιμάστε ξανά|αργότερα|παρακαλώ|στο πρόγραμμα περιήγησης|αρχική σελίδα|αυτή η σελίδα|για|να|η|το|στο|συνεχίσετε|λυπούμαστε"),
    "ar": ("الصفحة غير موجودة|لم يتم العثور على الصفحة|حدث خطأ ما|حدث خطأ|خطأ غير متوقع|خطأ في الخادم|خطأ داخلي|الخدمة غير متوفرة|غير متاح|تم رفض الوصول|قيد الصيانة|تفعيل جافا سكريبت|تمكين جافا سكريبت|يرجى تفعيل javascript", "يرجى المحاولة مرة أخرى|حاول مرة أخرى|لاحقا|لاحقًا|يرجى|من فضلك|في متصفحك|المتصفح|العودة إلى الصفحة الرئيسية|هذه الصفحة|عذرا|عذرًا|في|من|على|إلى"),
    "ja": ("ページが見つかりません|お探しのページは見つかりませんでした|ページは存在しません|エラーが発生しました|予期しないエラー|内部サーバーエラー|サーバーエラー|サーバエラー|エラー|サービスは利用できません|ご利用いただけません|利用できません|アクセスが拒否されました|アクセスできません|メンテナンス中|javascriptを有効に|javascriptが無効|javascript を有効に|javascript が無効|対応していません|セッションの有効期限|リクエストが多すぎます|読み込めませんでした|表示できません", "しばらくしてから|しばらく経ってから|もう一度お試しください|再度お試しください|お試しください|してください|ください|お使いのブラウザ|ブラウザの設定|ブラウザ|トップページ|へ戻る|申し訳ございません|申し訳ありません|ご覧になるには|表示するには|このページ|ページ|削除された|移動した|可能性があります|する|ため|には|を|は|が|の|に|で|と|か"),
    "zh": ("找不到页面|页面不存在|页面未找到|无法找到|出错了|发生错误|出现错误|服务器错误|内部错误|服务不可用|暂时不可用|无法访问|拒绝访问|访问被拒绝|正在维护|系统维护|启用javascript|启用 javascript|javascript已禁用|浏览器不支持|会话已过期|请求过多|加载失败|網頁不存在|找不到網頁|發生錯誤|伺服器錯誤|啟用javascript", "请稍后再试|请稍后重试|请重试|稍后|请|您的浏览器|浏览器|返回首页|您访问的页面|您要查找的|此页面|该页面|页面|抱歉|很抱歉|对不起|以|继续|查看|的|中|在|了|或|已|被|删除|移动"),
    "ko": ("페이지를 찾을 수 없습니다|존재하지 않는 페이지|오류가 발생했습니다|문제가 발생했습니다|예기치 않은 오류|서버 오류|내부 오류|서비스를 사용할 수 없습니다|사용할 수 없습니다|접근이 거부되었습니다|접근 권한이 없습니다|점검 중|자바스크립트를 활성화|javascript를 활성화|지원하지 않습니다|세션이 만료|요청이 너무 많습니다|불러올 수 없습니다", "잠시 후 다시 시도해 주세요|다시 시도해 주세요|다시 시도|잠시 후|브라우저에서|브라우저|홈으로|요청하신 페이지|이 페이지|죄송합니다|하세요|주세요|하려면|계속|보려면"),
}
STRONG += [plain(x) for strong, _ in FURTHER.values() for x in strong.split("|")]
WEAK += [plain(x) for _, weak in FURTHER.values() for x in weak.split("|")]

# Whole phrases of filler text.
FILL = """
lorem ipsum|texto de prueba|texto de ejemplo|texto de relleno|texto simulado|texto provisional|parrafo de relleno|prueba prueba prueba|ejemplo de encabezado|ejemplo de cuerpo|ejemplo de titulo|ejemplo de texto|muestra de parrafo sin contenido|muestra de parrafo|sin contenido|haga clic para anadir texto|haga clic para agregar texto|haga clic aqui para|su texto aparecera en este lugar|su texto aqui|tu texto aqui|el texto va aqui|sustituya este texto por el suyo|reemplace este texto|contenido pendiente de redactar|pendiente de redactar|contenido pendiente|pendiente de completar|este es un parrafo de relleno que se sustituira mas adelante|se sustituira mas adelante|seccion en construccion|pagina en construccion|en construccion|articulo en construccion|aqui va la introduccion del articulo|aqui va el|aqui va la|aqui ira|escriba aqui el resumen de la seccion|escriba aqui|escribe aqui|bla bla bla|asdf asdf|asdf|qwer|qwerty|por redactar
your text here|insert text here|click to add text|click to edit|sample text|dummy text|placeholder text|text goes here|content goes here|content coming soon|coming soon|under construction|replace this text|test test test|texto de exemplo|insira o texto|texte d'exemple|votre texte ici|testo di esempio|beispieltext|blindtext
this is a placeholder|this is sample text|filler text|your content here|add your text here|type your text here|enter text here|description goes here|title goes here|to be written|to be completed|page under construction|hello world|foo bar baz|the quick brown fox jumps over the lazy dog
texto de marcador|texto de muestra|texto falso|contenido de prueba|contenido de ejemplo|contenido de relleno|contenido proximamente|proximamente mas informacion|próximamente|pagina de prueba|articulo de prueba|anada su texto|escriba su texto|agregue su texto|descripcion pendiente|texto pendiente
texto de teste|texto provisorio|seu texto aqui|o seu texto aqui|em construcao|pagina em construcao|conteudo em breve|em breve|clique para adicionar texto
texte factice|texte de remplissage|texte provisoire|faux texte|page en construction|en construction|contenu a venir|cliquez pour ajouter du texte
testo segnaposto|testo di prova|testo provvisorio|il tuo testo qui|pagina in costruzione|in costruzione|contenuto in arrivo|clicca per aggiungere testo
platzhaltertext|fülltext|mustertext|ihr text hier|hier steht ihr text|dein text hier|seite im aufbau|im aufbau|inhalt folgt|klicken sie, um text hinzuzufügen
voorbeeldtekst|opvultekst|uw tekst hier|jouw tekst hier|pagina in aanbouw|in aanbouw|binnenkort beschikbaar
exempeltext|platshållartext|utfyllnadstext|din text här|sidan är under uppbyggnad|under uppbyggnad|kommer snart
eksempeltekst|pladsholdertekst|plassholdertekst|din tekst her|under opbygning|under utarbeidelse|kommer snart
esimerkkiteksti|täyteteksti|tekstisi tähän|sivu on rakenteilla|rakenteilla|tulossa pian
przykładowy tekst|tekst zastępczy|tekst przykładowy|twój tekst tutaj|strona w budowie|w budowie|treść wkrótce|wkrótce
ukázkový text|zástupný text|váš text zde|stránka je ve výstavbě|ve výstavbě|již brzy
text de exemplu|text de umplutură|textul tău aici|pagină în construcție|în construcție|în curând
mintaszöveg|helykitöltő szöveg|ide írja a szöveget|az oldal feltöltés alatt|feltöltés alatt|hamarosan
örnek metin|yer tutucu metin|metniniz buraya|yapım aşamasında|sayfa yapım aşamasındadır|çok yakında
adibide testua|zure testua hemen|eraikitzen|text d'exemple|text de mostra|el vostre text aquí|en construcció|texto de mostra|o seu texto aquí
contoh teks|teks contoh|teks anda di sini|dalam pembangunan|segera hadir|văn bản mẫu|nội dung mẫu|đang xây dựng|sắp ra mắt
пример текста|образец текста|текст-заполнитель|ваш текст здесь|введите текст|страница в разработке|в разработке|страница находится в стадии разработки|скоро будет|текст появится позже|приклад тексту|ваш текст тут|сторінка в розробці
δείγμα κειμένου|το κείμενό σας εδώ|υπό κατασκευή|نص تجريبي|نص بديل|قيد الإنشاء|ここにテキストを入力|サンプルテキスト|ダミーテキスト|準備中|工事中|近日公開|示例文本|在此输入文本|占位符文本|建设中|即将推出|예제 텍스트|여기에 텍스트를 입력|준비 중|공사 중
""".replace("\n", "|").strip("|").split("|")
FILL = [plain(x) for x in FILL]

# The vocabulary of the usual dummy Latin.
LATIN = frozenset(
    """lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud
    exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint
    occaecat cupidatat proident culpa officia deserunt mollit anim laborum vestibulum felis congue mattis ornare pretium varius turpis aliquet porta libero massa
    quam justo nunc viverra lectus mauris vivamus pellentesque fusce donec nam nec vitae tellus risus semper cursus diam eget egestas feugiat lacus ligula luctus
    maecenas malesuada metus morbi nibh odio orci pharetra phasellus praesent proin pulvinar purus sagittis sapien scelerisque sollicitudin suscipit tempus tincidunt
    tortor tristique ullamcorper urna vehicula vel venenatis volutpat vulputate integer imperdiet iaculis hendrerit habitant gravida fringilla faucibus facilisis
    euismod etiam erat efficitur dignissim dictum dapibus cras convallis condimentum blandit bibendum auctor arcu ante accumsan ac et ut in at""".split()
)
_COMMON = frozenset("ac et ut in at ante nam quam vel nec".split())

# A direction to the author in the place of a text.
_DIRECTION = re.compile(
    r"^\W*(?:(?:aqui|en este (?:hueco|espacio|lugar|apartado)),? )?(?:inserte|insertar|inserta|pegue|pegar|copie|copiar|coloque|colocar|redacte|redactar|redacta|anada|anadir|anade|agregue|agregar|escriba|escribir|escribe|complete|completar|completa|rellene|rellenar|ponga|poner|introduzca|introducir|incluya|incluir|indique|indicar|desarrolle|desarrollar|resuma|resumir|describa|por redactar|por escribir|por completar|falta (?:escribir|redactar|anadir|completar|el|la|un|una)|faltan?|pendiente(?: de \w+)?|proximamente|aqui (?:va|ira|iran|vendra)|se (?:anadira|completara|redactara)|insert|write|paste|add|describe|fill in|type|enter|put|insira|escreva|cole|adicione|inserez|collez|ecrivez|ajoutez|inserisci|scrivi|incolla|schreiben sie|fugen sie)\b[:,]?"
    r"(?: \w+){0,3}? (?:el|la|los|las|un|una|su|este|esta|the|a|an|your|o|um|uma|le|une|aqui)? ?(?:resumen|parrafo|parrafos|descripcion|cronologia|cuerpo|introduccion|texto|seccion|ficha|entradilla|biografia|contenido|listado|lista|tabla|imagen|titulo|bibliografia|historia|summary|paragraph|description|text|section|introduction|content|body|resumo|texto|descricao|paragraphe|texte|resume)\b"
)

# Names of template fields, without accents, number or language suffix.
FIELDS = frozenset(
    """nombre fecha ano anos titulo capital provincia gentilicio superficie poblacion fundacion descripcion imagen autor alcalde altitud rio pais ciudad region idioma lengua tema
    apellido apellidos direccion telefono correo email dia mes hora lugar valor texto contenido numero cantidad precio empresa producto categoria enlace url usuario cliente persona
    name first_name last_name firstname lastname date year title city country state address phone company product value text content number amount price author image link user customer
    month day time place description population area mayor river field placeholder variable nome data titre nom prenom date ville pays""".split()
)
_HTML_TAGS = frozenset("a abbr b blockquote body br button center code dd div dl dt em font footer form h1 h2 h3 h4 h5 h6 head header hr html i img input label li link main meta nav noscript ol p pre s script section small span strong style sub sup table tbody td th thead title tr u ul video".split())

#: Markers, each with what it begins with or, for the last ones, must hold. A pass of an automaton over the text finds
#: the beginnings of all kinds at once; the pattern is tried there only. No part of a pattern has a greatest length.
_MARKERS = {
    "braces": (("{{",), re.compile(r"\{\{\{?[^{}\n]*\}\}\}?")),
    "brace": (("{",), re.compile(r"(?<![\\{}^_\w$])\{(?:\d{1,2}|[^\W\d]\w*)\}(?!\})|(?<![\\{}^_\w$(\[=:])\{\s*\}(?!\})")),
    "dollar": (("${", "$("), re.compile(r"\$\{[^{}\n]+\}|\$\(\s*[^\W\d]\w*\s*\)")),
    "percent": (("%", "<%"), re.compile(r"<%[^%\n]+%>|(?<![\w%])%[^\W\d_]\w+%(?!\w)|(?<![\w%])%(?:s|d|\(\w+\)s)(?!\w)")),
    "at": (("@@",), re.compile(r"@@\s*[^\W\d]\w*\s*@@")),
    "under": (("__",), re.compile(r"(?<!\w)__[^\W_](?:\w*[^\W_])?__(?!\w)|(?<![\w_])_{3,}(?![\w_])")),
    "hash": (("#",), re.compile(r"(?<![\w#&])#[^\W\d_]\w*#(?![\w#])")),
    "square": (("[",), re.compile(r"\[\[?\s*(?:(?:su|tu|your|el|la)\s+)?(?:insertar|inserte|inserta|completar|complete|rellenar|poner|indicar|anadir|añadir|pegar|pegue|insert|enter|fill in|add|paste|einfügen|inserisci|inserir|insérer|wstaw|infoga)\b[\s:]*[^\W\d][\w\- ]*\]\]?|\[\[?\s*[^\W\d][\w\- ]*\s(?:aquí|aqui|here|hier|ici|qui)\s*\]\]?", re.I)),
    "quote": (("«",), re.compile(r"«\s*(?:(?:su|tu|your)\s+)?[^\W\d]\w*\s+(?:aquí|aqui|here)\s*»", re.I)),
    "crosses": (("XXX", "NNNN", "####", "9999-", "0000-", "DD", "YYYY", "TBD", "TBC", "FIXME"), re.compile(r"(?<!\w)(?:XXX\s+[^\W\d]\w*\s+XXX|X{4,}|N{4,}|#{4,}|9999-99-99|0000-00-00|DD[/-]MM[/-]AAAA|YYYY-MM-DD|TBD|TBC|FIXME)(?!\w)")),
    "doubt": (("¿¿??", "????"), re.compile(r"¿¿\?\?|\?{4,}")),
    "todo": (("TODO",), re.compile(r"(?<!\w)TODO(?!\w)")),
    "field": (("[", "<"), re.compile(r"\[\s*([^\W\d](?:\w|[ \-](?=\w))*)\s*\]|<\s*([^\W\d](?:\w|[ \-](?=\w))*)\s*>")),
    "colon": ((":",), re.compile(r"(?<![\w:/.\-)\]])::?([^\W\d]\w*)(?![\w:])")),
    "bar": (("|",), re.compile(r"(?<![\w|])\|([^\W\d]\w*)\|(?![\w|])")),
    "round": (("por definir", "por completar", "por confirmar", "por determinar", "pendiente", "to be defined"), re.compile(r"\(\s*[^\W\d]\w*\s+(?:por (?:definir|completar|confirmar|determinar)|pendiente|to be defined)\s*\)", re.I)),
    "here": (("_HERE",), re.compile(r"(?<!\w)[A-Z]{2,}_[A-Z_]{2,}_HERE(?!\w)")),
}
# Words that join the words of a field's name.
_JOINING = frozenset("de del la el los las do da dos das di du des of the your su tu seu der des".split())
# Words after which a marker or phrase is spoken of. "Campo de" is heraldry.
_MENTION = re.compile(
    r"(?:(?:variables?|marcas?|marcador(?:es)?|etiquetas?|plantillas?|parametros?|simbolos?|orden|ordenes|funcion|comandos?|instruccion|codigo|cadenas?|palabras?|expresion|secuencia|macros?|llamad[oa]s?|se escribe|escribir|escribe|escribiendo|sintaxis|forma|notacion|fields?|tags?|called|named|token|placeholder|el texto|un texto|el aviso|el mensaje|letrero|cartel|rotulo) ?(?:que dice ?|de |como )?|campos? ?(?:que dice ?|como )?)[:,]? ?[«\"“'`( ]*$"
)
_AFTER = re.compile(r"se (?:sustituye|rellena|reemplaza|cambia|escribe|usa|emplea|coloca)|al comienzo|es (?:una|la) (?:variable|marca|etiqueta|plantilla)|is (?:replaced|a placeholder)")
_CLOSING = re.compile(r"\s*[»\"”'`)]*\s*")
_QUOTES = re.compile(r"«[^«»]+»|“[^“”]+”|\"[^\"\n]+\"|`[^`\n]+`")
_TAG = re.compile(r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?/?>")
_HEADING = re.compile(r"^\s*(={2,6}).*\1\s*$|^\s*#{1,6}\s.*$")
_SENTENCE = re.compile(r"(?<=[.!?…])[\s]+|(?<=[。！？])|\n+")


# Words that begin a direction to the author.
_DIRECTING = """aqui|en este hueco|en este espacio|en este lugar|en este apartado|inserte|insertar|inserta|pegue|pegar|copie|copiar|coloque|colocar|redacte|redactar|redacta|anada|anadir|anade|agregue|agregar|escriba|escribir|escribe|complete|completar|completa|rellene|rellenar
ponga|poner|introduzca|introducir|incluya|incluir|indique|indicar|desarrolle|desarrollar|resuma|resumir|describa|por redactar|por escribir|por completar|falta|faltan|pendiente|proximamente|se anadira|se completara|se redactara|insert|write|paste|add|describe|fill in|type|enter|put
insira|escreva|cole|adicione|inserez|collez|ecrivez|ajoutez|inserisci|scrivi|incolla|schreiben sie|fugen sie""".replace("\n", "|").split("|")


def _automaton(*groups: tuple[str, list[str]]) -> ahocorasick.Automaton:
    trie = ahocorasick.Automaton()
    for kind, phrases in groups:
        for phrase in filter(None, phrases):
            kinds = trie.get(phrase, ("", 0))[0]
            trie.add_word(phrase, (kinds + kind, len(phrase)))
    trie.make_automaton()
    return trie


#: What makes a text worth a closer look, and all that counts within a sentence.
_TELLING = _automaton(("s", STRONG), ("f", FILL), ("d", _DIRECTING), ("l", [w for w in LATIN if w not in _COMMON]))
_EVERY = _automaton(("w", WEAK), ("s", STRONG), ("f", FILL))


def _hits(text: str, trie: ahocorasick.Automaton = _EVERY) -> list[tuple[int, int, str]]:
    """Phrases at word borders, as ``(start, end, kinds)``."""
    out = []
    for last, (kinds, length) in trie.iter(text):
        start, end = last - length + 1, last + 1
        if text[start] >= "\u2e80":  # scripts without spaces have no word borders
            out.append((start, end, kinds))
            continue
        if start and text[start - 1].isalnum() and text[start].isalnum():
            continue
        if end < len(text) and text[end].isalnum() and text[last].isalnum() and not ("s" in kinds and text[last].isdigit()):
            continue
        out.append((start, end, kinds))
    return out


_NO_LETTER = re.compile(r"[\W\d_]+")


def _share(sentence: str, kinds: str, hits: list[tuple[int, int, str]]) -> float:
    """The part of the sentence's letters that phrases of these kinds cover."""
    total = len(_NO_LETTER.sub("", sentence))
    if not total:
        return 0.0
    covered, at = 0, 0
    for start, end, kind in sorted(h for h in hits if any(k in h[2] for k in kinds)):
        start = max(start, at)
        if end > start:
            covered += len(_NO_LETTER.sub("", sentence[start:end]))
            at = end
    return covered / total


def _dummy_latin(sentence: str) -> bool:
    words = re.findall(r"[a-z]+", sentence)
    known = [w for w in words if w in LATIN]
    return len(words) >= 3 and len(known) >= 0.7 * len(words) and sum(w not in _COMMON for w in known) >= 0.5 * len(words)


def _words_before(text: str, at: int) -> str:
    """The last words before a place, in plain letters and with single spaces: as many as a mention can have. Of a
    word longer than all words of a mention, the end."""
    out: list[str] = []
    words, run = 0, 0
    i = at - 1
    while i >= 0:
        c = text[i]
        if c.isspace():
            if out and out[-1] != " ":
                words += run > 0
                if words > 4:
                    break
                out.append(" ")
            run = 0
        else:
            run = run + 1 if c.isalnum() else 0
            if run > 24:
                break
            out.append(c)
        i -= 1
    return plain("".join(reversed(out)))


def _spoken_of(text: str, start: int, end: int, quoted: list[tuple[int, int]], itself_quote: bool) -> bool:
    if not itself_quote and quoted:
        at = bisect_right(quoted, (start, len(text))) - 1
        if at >= 0 and end <= quoted[at][1]:
            return True
    after = _CLOSING.match(text, end).end()
    return bool(_MENTION.search(_words_before(text, start))) or bool(_AFTER.match(plain(text[after : after + 40])))


def _field_name(name: str) -> bool:
    """All words are names of fields, or a field's name and "of" something."""
    base = re.sub(r"(?:_?\d{1,2}|_(?:es|en|pt|fr))$", "", plain(name.strip()))
    if base.replace(" ", "_") in FIELDS:
        return True
    words = re.split(r"[ _\-]+", base)
    return words[0] in FIELDS and len(words) > 1 and (words[1] in _JOINING or all(w in FIELDS for w in words[1:]))


def _marker_trie() -> ahocorasick.Automaton:
    trie = ahocorasick.Automaton()
    for kind, (begins, _) in _MARKERS.items():
        for begin in begins:
            kinds = trie.get(begin, ("", 0))[0]
            trie.add_word(begin, (f"{kinds} {kind}".strip(), len(begin)))
    trie.make_automaton()
    return trie


_BEGINS = _marker_trie()


def _plainly_written(text: str, at: int, lines: dict[int, bool]) -> bool:
    """The line is not all in capitals; each line is looked at once."""
    start = text.rfind("\n", 0, at) + 1
    if start not in lines:
        stop = text.find("\n", at)
        line = text[start : len(text) if stop < 0 else stop]
        lines[start] = sum(c.islower() for c in line) > sum(c.isupper() for c in line)
    return lines[start]


def unfilled_field(text: str, quoted: list[tuple[int, int]] | None = None) -> str | None:
    """The first unfilled field that is not only spoken of."""
    if quoted is None:
        quoted = [m.span() for m in _QUOTES.finditer(text)]
    done: dict[str, int] = {}
    lines: dict[int, bool] = {}
    for last, (kinds, length) in _BEGINS.iter(text):
        for kind in kinds.split(" "):
            start = last - length + 1
            if kind == "round":
                start = text.rfind("(", done.get(kind, 0), start)
            elif kind == "here":
                while start > 0 and (text[start - 1].isupper() or text[start - 1] == "_"):
                    start -= 1
            if start < done.get(kind, 0):
                continue  # inside the one before
            m = _MARKERS[kind][1].match(text, start)
            if m is None:
                continue
            done[kind] = m.end()
            shown = m.group()
            if kind == "braces" and not shown.strip("{}| \t"):
                continue
            if kind == "todo" and not _plainly_written(text, m.start(), lines):
                continue
            if kind in ("field", "colon", "bar"):
                name = next(g for g in m.groups() if g is not None)
                if (shown[0] == "<" and name.lower() in _HTML_TAGS) or not _field_name(name):
                    continue
            if not _spoken_of(text, *m.span(), quoted, kind == "quote"):
                return shown
    return None


def residue(text: str | None, sentence_share: float = 0.5, text_share: float = 0.6) -> str | None:
    """``template``, ``filler``, ``error`` or None for one text. Null and blank texts hold nothing."""
    if not text or text.isspace():
        return None
    shown = html.unescape(text) if "&" in text else text
    quoted = [m.span() for m in _QUOTES.finditer(shown)]
    if unfilled_field(shown, quoted) is not None:
        return TEMPLATE
    bare = _TAG.sub(lambda m: " " * len(m.group()), shown) if "<" in shown else shown
    if quoted:
        bare = _QUOTES.sub(lambda m: "§" * len(m.group()), bare)
    p = plain(bare)
    telling = _hits(p, _TELLING)
    if not telling:
        return None
    spans = _sentences(p)
    starts = [a for a, _ in spans]
    within: dict[int, str] = {}
    for start, _, kinds in telling:
        i = bisect_right(starts, start) - 1
        if i >= 0 and start < spans[i][1]:
            within[i] = within.get(i, "") + kinds
    strong = False
    flagged: dict[int, bool] = {}

    def is_notice(i: int) -> bool:
        if i not in flagged:
            sentence = p[slice(*spans[i])]
            flagged[i] = _share(sentence, "sw", _hits(sentence)) >= sentence_share or bool(_FURNITURE.fullmatch(sentence))
        return flagged[i]

    for i, kinds in within.items():
        sentence = p[slice(*spans[i])]
        if "§" not in sentence:
            if "f" in kinds and _share(sentence, "f", _hits(sentence)) >= sentence_share:
                return FILLER
            if (kinds.count("l") > 1 and _dummy_latin(sentence)) or ("d" in kinds and _DIRECTION.match(sentence)):
                return FILLER
        strong = strong or ("s" in kinds and is_notice(i))
    if not strong:
        return None
    sizes = [b - a for a, b in spans]
    if len(spans) > 1 and sizes[0] <= 90 and not any(k in within.get(0, "") for k in "sf"):
        sizes[0] = 0  # a title line, or the title as a sentence
    allowed = (1 - text_share) * sum(sizes)
    for i, size in enumerate(sizes):
        if size and not is_notice(i):
            allowed -= size
            if allowed < 0:
                return None
    return ERROR


_FURNITURE = re.compile(r"[\W\d_a-f]*|\W*nginx\W*")


def _sentences(text: str) -> list[tuple[int, int]]:
    """Where the sentences lie, without headings and what has no letter, digit or quotation."""
    out, at = [], 0
    for line in text.split("\n"):
        if line and not _HEADING.match(line):
            start = at
            for m in [*_SENTENCE.finditer(line), None]:
                end = at + (m.start() if m else len(line))
                piece = text[start:end]
                lead = len(piece) - len(piece.lstrip())
                if any(c.isalnum() or c == "§" for c in piece):
                    out.append((start + lead, start + len(piece.rstrip())))
                start = at + m.end() if m else end
        at += len(line) + 1
    return out


def _judge(id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = [residue(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kinds, pa.string())], names=[b.schema.names[0], "kind"])

    return run


def residue_kinds(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(<id>, kind)`` per document; ``kind`` is null where the text is real content.

    Null and blank texts hold nothing and give null. Repeated rows are judged each.
    An empty table gives no rows. Other columns are not read.
    """
    slim = spread(documents.select(id_column, text_column))
    return slim.mapInArrow(_judge(None), f"{id_column} {slim.schema[id_column].dataType.simpleString()}, kind string")


def documents_with_residue(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(<id>)`` of the documents to be excluded, once each."""
    return residue_kinds(documents, id_column, text_column).filter(F.col("kind").isNotNull()).select(id_column).distinct()


def without_residue(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents without the excluded ones, all columns kept. Rows with a null id stay
    unless their own text is residue."""
    width = len(documents.columns)
    names = [f"c{i}" for i in range(width)]
    slim = spread(documents.toDF(*names))
    text = names[documents.columns.index(text_column)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array([residue(t) is None for t in b.column(b.schema.get_field_index(text)).to_pylist()], pa.bool_())
            yield b.filter(keep)

    return slim.mapInArrow(run, slim.schema).toDF(*documents.columns)
