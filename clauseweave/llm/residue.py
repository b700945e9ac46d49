"""Template residue, filler and error or script notices (problem 3).

One Aho-Corasick automaton holds all literals: messages in nine languages, filler phrases, stems of
Latin dummy text and the signs that open a template slot. It runs once over each text. What the
matched phrases cover is set against the length of the text; a hit on an opening sign or on a stem
is verified at its place (is the slot closed, does it hold a field; does the stem's word end as
dummy text does), in time proportional to the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import product

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, functions as F

COVERAGE = 0.55  # share of the letters of a text that matched phrases must cover


def _list(text: str) -> list[str]:
    return [p for p in text.replace("\n", "|").split("|") if p]


# What messages are about and what they say of it, by language; each pair is a message.
SAID = {
    "en": (
        """page|file|document|content|site|website|web page|server|service|resource|url|link|app|application|session|access|video|address|domain|account|item|article|database|connection|request
requested page|requested url|requested resource|requested file|page you requested|page you are looking for|page you were looking for|page you asked for|page you are trying to reach|domain name|host|network|system|feature|operation|transaction|upload|download|login|sign-in|form|token|certificate|component|module|script|plugin|image|player|map|viewer""",
        """not found|was not found|could not be found|cannot be found|can't be found|does not exist|doesn't exist|no longer exists|isn't here|is gone|has been moved|has moved|has been moved or deleted|was moved or deleted|may have been moved|has been removed|has been deleted
is not available|isn't available|not available|is unavailable|unavailable|is temporarily unavailable|temporarily unavailable|is currently unavailable|is no longer available|is not available in your region|is not available in your country|cannot be displayed|can't be displayed|cannot be shown|could not be loaded|couldn't be loaded|failed to load|failed|has failed
is down|is down for maintenance|is under maintenance|is under construction|is offline|has expired|expired|is invalid|is not valid|timed out|has timed out|denied|is denied|was denied|forbidden|is forbidden|refused|was refused|rejected|blocked|was blocked|is blocked|has been blocked|is restricted|has been suspended|is suspended|is disabled|is broken|could not be completed|could not be processed|cannot be processed|couldn't be opened
took too long to respond|is taking too long|is parked|is for sale|is not responding|isn't responding|did not respond|is not reachable|cannot be reached|can't be reached|unreachable|was reset|was lost|is not private|is not secure|encountered an error|has encountered an error|has crashed|stopped working|is overloaded|is busy""",
    ),
    "de": (
        """seite|die seite|diese seite|die angeforderte seite|die gewünschte seite|die gesuchte seite|webseite|website|datei|die datei|dokument|das dokument|inhalt|der inhalt|dieser inhalt|server|der server|dienst|der dienst|der service|link|der link|sitzung|die sitzung|ihre sitzung|zugriff|der zugriff|verbindung|die verbindung|anfrage|die anfrage|ihre anfrage|adresse|diese adresse|anmeldung|diese domain|konto|ihr konto|datenbank|die datenbank|anwendung|die anwendung""",
        """nicht gefunden|wurde nicht gefunden|konnte nicht gefunden werden|existiert nicht|existiert nicht mehr|gibt es nicht|gibt es nicht mehr|ist nicht verfügbar|nicht verfügbar|ist derzeit nicht verfügbar|ist derzeit nicht erreichbar|ist nicht erreichbar|ist vorübergehend nicht verfügbar|wurde verschoben|wurde gelöscht|wurde entfernt|abgelaufen|ist abgelaufen|verweigert|wurde verweigert|verboten|gesperrt|ist gesperrt|wurde abgelehnt|abgelehnt|fehlgeschlagen|ist fehlgeschlagen|wurde unterbrochen|unterbrochen|konnte nicht geladen werden|kann nicht angezeigt werden|konnte nicht verarbeitet werden|antwortet nicht|ist in ihrem land nicht verfügbar|wird gewartet|befindet sich im aufbau|ist überlastet|ist ungültig""",
    ),
    "fr": (
        """page|la page|cette page|la page demandée|la page que vous cherchez|la page que vous recherchez|fichier|le fichier|document|le document|ce document|contenu|le contenu|ce contenu|site|le site|ce site|serveur|le serveur|service|le service|ce service|lien|le lien|ce lien|session|la session|votre session|accès|l'accès|connexion|la connexion|requête|la requête|votre requête|votre demande|adresse|cette adresse|ce domaine|votre compte|base de données|l'application""",
        """introuvable|est introuvable|non trouvée|non trouvé|n'existe pas|n'existe plus|n'a pas été trouvée|n'a pas été trouvé|n'est pas disponible|n'est plus disponible|indisponible|est indisponible|est temporairement indisponible|temporairement indisponible|a été déplacée|a été déplacé|a été supprimée|a été supprimé|a expiré|expirée|expiré|refusé|est refusé|refusée|interdit|est interdit|bloqué|a échoué|échouée|n'a pas pu être chargée|n'a pas pu être chargé|ne peut pas être affichée|ne peut pas être affiché|ne répond pas|est en maintenance|est en construction|n'est pas disponible dans votre pays|n'est pas disponible dans votre région|est invalide|invalide|a été interrompue""",
    ),
    "es": (
        """página|la página|esta página|la página solicitada|la página que busca|la página que buscas|archivo|el archivo|documento|el documento|contenido|el contenido|este contenido|sitio|el sitio|este sitio|servidor|el servidor|servicio|el servicio|este servicio|enlace|el enlace|sesión|la sesión|su sesión|tu sesión|acceso|el acceso|conexión|la conexión|solicitud|la solicitud|su solicitud|dirección|esta dirección|este dominio|su cuenta|base de datos|la aplicación""",
        """no encontrada|no encontrado|no se encuentra|no se ha encontrado|no se encontró|no existe|ya no existe|no está disponible|no disponible|ya no está disponible|no está disponible en su país|no está disponible en su región|temporalmente no disponible|ha sido movida|ha sido eliminada|ha sido eliminado|fue eliminada|ha caducado|ha expirado|caducada|expirada|denegado|ha sido denegado|prohibido|rechazada|bloqueado|ha fallado|fallida|no se pudo cargar|no se ha podido cargar|no se puede mostrar|no responde|está en mantenimiento|en mantenimiento|está en construcción|en construcción|no es válida|no válida|se ha interrumpido""",
    ),
    "it": (
        """pagina|la pagina|questa pagina|la pagina richiesta|la pagina cercata|la pagina che cerchi|file|il file|documento|il documento|contenuto|il contenuto|questo contenuto|sito|il sito|questo sito|server|il server|servizio|il servizio|questo servizio|link|il link|sessione|la sessione|la tua sessione|accesso|l'accesso|connessione|la connessione|richiesta|la richiesta|la tua richiesta|indirizzo|questo indirizzo|questo dominio|il tuo account|database|l'applicazione""",
        """non trovata|non trovato|non è stata trovata|non è stato trovato|non esiste|non esiste più|non è disponibile|non disponibile|non è più disponibile|temporaneamente non disponibile|è temporaneamente non disponibile|non è disponibile nel tuo paese|è stata spostata|è stata rimossa|è stato rimosso|è stata eliminata|è scaduta|scaduta|scaduto|negato|è negato|vietato|rifiutata|bloccato|non riuscita|fallita|non può essere visualizzata|non può essere visualizzato|impossibile da caricare|non risponde|è in manutenzione|in manutenzione|è in costruzione|in costruzione|non è valida|non valida|è stata interrotta""",
    ),
    "nl": (
        """pagina|de pagina|deze pagina|de opgevraagde pagina|de gevraagde pagina|de pagina die u zoekt|bestand|het bestand|document|het document|inhoud|de inhoud|deze inhoud|site|de site|deze site|website|deze website|server|de server|dienst|de dienst|deze dienst|link|de link|deze link|sessie|de sessie|uw sessie|je sessie|toegang|de toegang|verbinding|de verbinding|verzoek|het verzoek|uw verzoek|adres|dit adres|dit domein|uw account|database|de applicatie""",
        """niet gevonden|is niet gevonden|werd niet gevonden|kon niet worden gevonden|kan niet worden gevonden|bestaat niet|bestaat niet meer|is niet beschikbaar|niet beschikbaar|is tijdelijk niet beschikbaar|tijdelijk niet beschikbaar|is niet meer beschikbaar|is niet beschikbaar in uw land|is verplaatst|is verwijderd|is verlopen|verlopen|geweigerd|is geweigerd|verboden|geblokkeerd|is geblokkeerd|is mislukt|mislukt|kon niet worden geladen|kan niet worden weergegeven|reageert niet|is in onderhoud|in onderhoud|is in aanbouw|is ongeldig|ongeldig|is verbroken|verbroken""",
    ),
    "pt": (
        """página|a página|esta página|a página solicitada|a página que procura|a página que você procura|ficheiro|arquivo|o arquivo|documento|o documento|conteúdo|o conteúdo|este conteúdo|site|o site|este site|servidor|o servidor|serviço|o serviço|este serviço|link|o link|sessão|a sessão|sua sessão|a sua sessão|acesso|o acesso|conexão|a conexão|ligação|a ligação|solicitação|a solicitação|seu pedido|endereço|este endereço|este domínio|sua conta|base de dados|a aplicação|o aplicativo""",
        """não encontrada|não encontrado|não foi encontrada|não foi encontrado|não existe|já não existe|não existe mais|não está disponível|não disponível|indisponível|temporariamente indisponível|está temporariamente indisponível|não está disponível no seu país|não está disponível na sua região|foi movida|foi removida|foi removido|foi excluída|expirou|expirada|negado|foi negado|proibido|recusada|bloqueado|falhou|não pôde ser carregada|não pode ser exibida|não pode ser exibido|não responde|está em manutenção|em manutenção|está em construção|em construção|não é válida|inválida|foi interrompida""",
    ),
    "pl": (
        """strona|ta strona|żądana strona|szukana strona|strona, której szukasz|plik|ten plik|dokument|ten dokument|treść|ta treść|witryna|ta witryna|serwer|usługa|ta usługa|link|ten link|sesja|twoja sesja|dostęp|połączenie|żądanie|twoje żądanie|adres|ten adres|ta domena|twoje konto|baza danych|aplikacja""",
        """nie znaleziona|nie znaleziono|nie została znaleziona|nie został znaleziony|nie istnieje|już nie istnieje|jest niedostępna|jest niedostępny|niedostępna|niedostępny|nie jest dostępna|nie jest dostępny|chwilowo niedostępna|jest chwilowo niedostępna|została przeniesiona|została usunięta|został usunięty|wygasła|wygasł|zabroniony|zabronione|odrzucone|zablokowany|nie powiodło się|nie odpowiada|nie można wyświetlić|w trakcie przerwy technicznej|w budowie|jest nieprawidłowy|zostało przerwane""",
    ),
    "ru": (
        """страница|эта страница|данная страница|запрашиваемая страница|запрошенная страница|файл|этот файл|документ|этот документ|контент|содержимое|сайт|этот сайт|сервер|сервис|служба|ссылка|сессия|ваша сессия|сеанс|ваш сеанс|доступ|соединение|запрос|ваш запрос|адрес|этот адрес|этот домен|ваша учётная запись|база данных|приложение""",
        """не найдена|не найден|не найдено|не существует|больше не существует|недоступна|недоступен|недоступно|временно недоступна|временно недоступен|временно недоступно|не доступна|недоступна в вашем регионе|недоступен в вашей стране|была перемещена|была удалена|удалена|удалён|удален|истекла|истек|истёк|запрещён|запрещен|отклонён|отклонен|заблокирован|не удался|не удалось загрузить|не отвечает|на техническом обслуживании|в разработке|недействительна|прервано""",
    ),
}
# Further messages of servers, applications and access controls.
ERRORS = _list("""
not found|forbidden|service unavailable|the server at|took too long to respond|failure|bad gateway|gateway timeout|gateway time-out|internal error|internal server error|server error|unauthorized|unauthorised|bad request|too many requests|request timeout|not implemented|method not allowed|payload too large|conflict detected|precondition failed|length required|unsupported media type
something went wrong on our side|something went wrong|looks like something went wrong|something isn't right|that didn't work|an error occurred|an error has occurred|an unexpected error occurred|an unexpected error has occurred|a client-side exception has occurred|a server-side exception has occurred|unexpected error|unknown error|fatal error|application error|runtime error|script error|database error|system error|network error
error establishing a database connection|could not reach the database|could not connect to|unable to connect|has no account with this host|we can't find that page|we couldn't find that page|we can't seem to find the page|we could not find what you were looking for|sorry, this document|nothing lives at|nothing was found here|there is nothing here|this page isn't working|this site can't be reached|dead link|broken link|page has moved
security check|prove that you are human|verify you are human|verify that you are human|confirm you are not a robot|i'm not a robot|are you a robot|complete the captcha|captcha|checking your browser|checking if the site connection is secure|please sign in again|please log in again|please sign in to continue|please log in to continue|you need to log in|you must be logged in|login required|sign in required
slow down and retry in|rate limit exceeded|you have been blocked|quota exceeded|bandwidth limit exceeded|resource limit is reached|you do not have permission|you don't have permission|you are not authorized|you are not authorised|you are not allowed to|permission denied|insufficient permissions|you have been logged out|you have been signed out
upstream failure|upstream connect error|upstream|connection refused|connection reset by peer|dns lookup failed|name resolution failed|ssl handshake failed|no healthy upstream|too many redirects|invalid csrf token|invalid request|invalid token|invalid url
nullreference at|null reference|nullpointerexception|uncaught exception|uncaught typeerror|uncaught referenceerror|uncaught error|uncaught|unhandled exception|unhandled rejection|exception in thread|cannot read section|cannot read property|cannot read properties of|is not a function|is not defined|stack trace|stack overflow|traceback (most recent call last)|undefined index|undefined variable|undefined offset|segmentation fault|syntax error|parse error|out of memory|core dumped|no such file or directory
interner fehler|interner serverfehler|ein fehler ist aufgetreten|es ist ein fehler aufgetreten|unbekannter fehler|unerwarteter fehler|da ist etwas schiefgelaufen|etwas ist schiefgelaufen|sie haben keine berechtigung|keine berechtigung|bitte melden sie sich erneut an|bitte melden sie sich an|zu viele anfragen|zeitüberschreitung|wartungsarbeiten|wegen wartungsarbeiten|serverfehler|ungültige anfrage|hier gibt es nichts zu sehen
une erreur interne est survenue|une erreur est survenue|une erreur s'est produite|une erreur inattendue|erreur interne|erreur interne du serveur|erreur inconnue|oups, une erreur|un problème est survenu|quelque chose s'est mal passé|vous n'avez pas l'autorisation|vous n'avez pas accès|veuillez vous reconnecter|veuillez vous connecter|trop de requêtes|délai d'attente dépassé|maintenance en cours|requête invalide
ha ocurrido un error|se ha producido un error|se produjo un error|error interno|error interno del servidor|error desconocido|error inesperado|algo salió mal|algo ha salido mal|no tiene permiso|no tienes permiso|inicie sesión de nuevo|vuelva a iniciar sesión|demasiadas solicitudes|tiempo de espera agotado|solicitud incorrecta
si è verificato un errore|errore interno|errore interno del server|errore sconosciuto|errore imprevisto|qualcosa è andato storto|non hai i permessi|non hai l'autorizzazione|accedi di nuovo|effettua di nuovo l'accesso|troppe richieste|tempo scaduto|richiesta non valida
er is een fout opgetreden|er is iets misgegaan|er ging iets mis|interne fout|interne serverfout|onbekende fout|onverwachte fout|geen toegang|u hebt geen toestemming|u heeft geen toestemming|meld u opnieuw aan|log opnieuw in|te veel verzoeken|time-out van de verbinding|ongeldig verzoek
ocorreu um erro|ocorreu um erro inesperado|erro interno|erro interno do servidor|erro desconhecido|algo deu errado|algo correu mal|você não tem permissão|não tem permissão|sem permissão|inicie sessão novamente|faça login novamente|demasiados pedidos|muitas solicitações|tempo esgotado|pedido inválido
wystąpił błąd|wystąpił nieoczekiwany błąd|błąd wewnętrzny|wewnętrzny błąd serwera|błąd serwera|nieznany błąd|coś poszło nie tak|odmowa dostępu|brak dostępu|brak uprawnień|nie masz uprawnień|zaloguj się ponownie|zbyt wiele żądań|przekroczono limit czasu|nie znaleziono strony|nie znaleziono pliku|nieprawidłowe żądanie|przerwa techniczna
произошла ошибка|возникла ошибка|внутренняя ошибка|внутренняя ошибка сервера|ошибка сервера|неизвестная ошибка|что-то пошло не так|нет доступа|нет прав|у вас нет прав|у вас нет доступа|войдите снова|войдите ещё раз|слишком много запросов|время ожидания истекло|неверный запрос|технические работы
""")
# Words by which a message gives its number, and ends of stack frames.
STATUS = ["http", "http/0.0", "error", "error code", "status", "status code", "code", "fehler", "fehlercode", "erreur", "code d'erreur", "errore", "erro", "fout", "foutcode", "błąd", "kod błędu", "ошибка", "код ошибки"]
FRAMES = [".js:", ".ts:", ".py:", ".php:", ".java:", ".cs:", ".rb:", ".go:"]

# Words around such messages; they count only beside a message.
AROUND = _list("""
error|fehler|erreur|errore|erro|fout|błąd|ошибка|code|http|status|incident|reference|request id|ray id|oops|whoops|ooops|uh-oh|sorry|hoppla|ups|oups|oeps|ой|fatal|warning|exception|failure|the|this|that|a|an|we're|it seems|it looks like|looks like|now|here
try again later|please try again later|please try again|try again|please reload|reload the page|refresh the page|reload|contact the site owner|contact support|contact the administrator|contact your administrator|go back to the start page|go back|back to home|go to the homepage|return to the homepage|check the url|check the address
we are on it|buy today|buy|today|seconds|in your browser|your browser|browser|before you go on|please wait|on line|line|view.render|render|load|at|.load|.js|.inc|in order to|continue|first|to continue to|while processing your request
switch it on and reload|allow it for|and try again|to open|to read|to view|to use|to see|to continue|to proceed|before you use|is required|are required|required|please|properly|correctly|reset reason|section|reason|at this host|timeout
bitte|bitte versuchen sie es später erneut|versuchen sie es später erneut|später erneut|erneut|laden sie die seite neu|um fortzufahren|in ihrem browser|ihrem browser|um diese seite anzuzeigen|um diese seite zu sehen|um den inhalt anzuzeigen|diese|seite|die|der|das|es|ist|leider
veuillez|veuillez réessayer|veuillez réessayer plus tard|réessayer plus tard|réessayez|dans votre navigateur|votre navigateur|pour afficher ce contenu|pour afficher cette page|pour continuer|cette page|la|le|une|désolé|désolés
por favor|inténtelo de nuevo|inténtelo más tarde|vuelva a intentarlo|en su navegador|en tu navegador|su navegador|para continuar|para ver|para ver esta página|de la página|de esta página|esta página|el|lo sentimos
per favore|riprova|riprova più tardi|si prega di riprovare|nel tuo browser|nel browser|il tuo browser|per continuare|per leggere|per visualizzare|per visualizzare questa pagina|occorre|questa pagina|il|siamo spiacenti
alstublieft|probeer het opnieuw|probeer het later opnieuw|in uw browser|in je browser|uw browser|om verder te gaan|om deze pagina te bekijken|deze pagina|de|het|helaas|in|om
tente novamente|tente novamente mais tarde|tente mais tarde|no seu navegador|em seu navegador|seu navegador|para continuar|para ver esta página|para visualizar|esta página|o|desculpe|lamentamos
proszę|spróbuj ponownie|spróbuj ponownie później|w przeglądarce|w swojej przeglądarce|twoja przeglądarka|aby kontynuować|aby wyświetlić|aby zobaczyć|tę stronę|przepraszamy|niestety
пожалуйста|попробуйте ещё раз|попробуйте еще раз|попробуйте позже|повторите попытку|повторите попытку позже|в вашем браузере|в браузере|ваш браузер|чтобы продолжить|для просмотра|для просмотра страницы|эту страницу|извините|к сожалению|этой страницы
the document|the notice|this page|this app|this policy|the page|the policy|this site|this website|this content|the content|policy_|the database|page|content|site|app
""")

# Placeholder and drafting texts.
FILLERS = _list("""
lorem ipsum|dolor sit amet|consectetur adipiscing elit|lipsum|sample text|placeholder text|dummy text|filler text|heading placeholder|placeholder|example text|text placeholder|title placeholder|your headline here|your title here|your content here|content goes here|content to follow|text to follow
blah blah|test test|asdf asdf|asdf|qwerty|foo bar baz|foo bar|the quick brown fox jumps over the lazy dog|your text here|text goes here|insert text here|insert content here|type something here|type your text here|write something here|enter text here|enter your text here
add a short description of your service here|add your text here|add your content here|add text here|add a description|click edit to change this text|click here to edit|click to edit|click to add text|double click to edit|edit this text|replace this text with your own policy|replace this text|replace with your own text|replace me|change me|this is where your text goes
coming soon|this is a demo page|this is a sample page|this is an example page|this is a test page|this is just a test|this page is under construction|under construction|hier steht ihr text|hier entsteht|hier kommt ihr text|ihr text hier|votre texte ici|insérez votre texte|saisissez votre texte|su texto aquí|tu texto aquí|escriba su texto aquí|il tuo testo qui|inserisci qui il testo|inserisci il tuo testo|uw tekst hier|plaats hier uw tekst|voer hier uw tekst in|o seu texto aqui|seu texto aqui|insira o seu texto|twój tekst tutaj|wpisz tekst|tutaj wpisz swój tekst|ваш текст здесь|введите текст|здесь будет текст
paragraph one|paragraph two|paragraph three|paragraph four|section about|template section: delete if you do not use|delete if you do not use|delete this section|delete this paragraph|delete before publishing|remove before publishing|remove this section|remove before release
do not publish|not for publication|for internal review only|for internal use only|draft|first draft|draft version|fixme wording|fixme|fix me wording|todo: legal to confirm this paragraph|legal to confirm|todo|tbd|tbc|to be completed by counsel|to be reviewed by legal|pending legal review|awaiting legal review|check wording|wording tbc|needs review
hello world|text block|texte à venir|texte provisoire|faux texte|beispieltext|blindtext|platzhalter|platzhaltertext|mustertext|texte d'exemple|texto de ejemplo|texto de relleno|texto de prueba|testo di prova|testo di esempio|testo segnaposto|texto de exemplo|texto de teste|voorbeeldtekst|plaatshoudertekst|opvultekst|tekst przykładowy|przykładowy tekst|tekst zastępczy|пример текста|текст-заполнитель|текст-рыба|тестовый текст
to be completed|to be confirmed|to be determined|to be decided|to be announced|insert wording|wording to follow|note to self|check with legal|ask legal|final wording pending|noch zu ergänzen|noch zu prüfen|entwurf|à compléter|à confirmer|brouillon|por completar|borrador|da completare|bozza|nog in te vullen|concept|a preencher|rascunho|do uzupełnienia|wersja robocza|черновик|заполнить позже
""")

# What a notice asks to turn on, how it asks, and what it says is missing; each way of joining them is a phrase.
SCRIPT = ["javascript", "java script", "js", "scripts", "scripting", "script", "cookies", "javascript and cookies", "cookies and javascript"]
ASK = _list("""enable|activate|allow|turn on|switch on|re-enable|unblock|activer|activez|autoriser|autorisez|aktivieren sie|schalten sie|erlauben sie|attivare|attiva|abilita|abilitare|consenti|active|activar|activa|habilite|habilita|habilitar|permita
ative|ativar|permita|włącz|włączyć|zezwól na|включите|включить|разрешите|schakel|zet|activeer|sta toe""")
NOTICE = _list("""{} is turned off|{} is disabled|{} are disabled|{} is switched off|{} is blocked|{} is not enabled|{} must be enabled|{} needs to be enabled|{} has to be enabled|{} should be enabled|{} is required|{} are required|without {}|needs {}|need {}|requires {}|relies on {}|uses {}|doesn't work without {}|does not work without {}|won't work without {}|works best with {}|your browser can run {}|does not support {}|doesn't support {}|browser is too old or blocks {}|blocks {}|no {}
{} ist deaktiviert|{} ist ausgeschaltet|{} wird benötigt|{} ist erforderlich|{} muss aktiviert sein|benötigt {}|ohne {}|unterstützt kein {}|{} est désactivé|{} est requis|{} est nécessaire|{} doit être activé|nécessite {}|sans {}|{} está desactivado|{} está deshabilitado|{} es necesario|se requiere {}|requiere {}|no admite {}|necesita {}|sin {}|{} è disattivato|{} è disabilitato|{} è necessario|richiede {}|senza {}|{} is uitgeschakeld|{} is vereist|vereist {}|zonder {}
{} está desativado|{} é necessário|requer {}|precisa de {}|sem {}|{} jest wyłączony|{} jest wymagany|wymaga {}|bez {}|{} отключен|{} отключён|{} выключен|требуется {}|требует {}|необходим {}|без {}|поддержку {}""")
SCRIPT_EXTRA = _list("""
noscript: content unavailable|noscript|stays empty|cannot be shown|loads dynamically|checking that your browser can run|this viewer needs|so this page cannot be shown
su navegador no admite|o lo tiene desactivado|we're sorry|doesn't work without|in om verder te gaan|is turned off in your browser|your browser is not supported|your browser is out of date|browser not supported|unsupported browser|upgrade your browser|update your browser
""")

# Names of template fields; a weakly marked slot holds only such words.
FIELDS = set(
    """address agent app application authority business city client code company contact controller country customer data date day dd department description
    domain dpo effective email entity fax field firm first from full goes here house id industry insert last law legal link mail month name number office officer organisation
    organization owner page period person phone policy post postal privacy product provider region registered registration representative retention revised service site state street
    tel telephone text title todo type updated url user value vat version web website year your yourdomain yourcompany zip mm yyyy xx tbd tbc fixme
    firma der nom de la société razón social nome azienda empresa naam bedrijf nazwa firmy название компании adresse datum fecha data""".split()
)
# Signs that open and close a slot; in a strong pair any words are a slot, in a weak one only fields.
STRONG = [("{{", "}}"), ("[[", "]]"), ("<<", ">>"), ("&lt;", "&gt;"), ("$$", "$$"), ("@@", "@@"), ("*|", "|*"), ("<%", "%>"), ("{%", "%}"), ("${", "}"), ("#{", "}"), ("{!", "}")]
WEAK = [("<", ">"), ("«", "»"), ("[", "]"), ("{", "}"), ("%", "%"), ("|", "|"), ("~", "~"), ("#", "#"), ("__", "__"), ("(your ", ")")]
ASKING = ["describe", "insert", "add", "enter", "explain", "list", "specify", "your", "name of", "date of", "nom de", "nombre de", "razón", "name der", "nome d", "hier", "indiquer", "insérer", "inserire", "indicar", "vul in", "wpisz", "укажите"]
# Slots that are whole literals.
BARE = ["[●]", "[object object]", "xxxx", "????", "_____", "xx/xx/xx", "xx/xx/20xx", "xx.xx.20xx", "dd/mm/yyyy", "dd.mm.yyyy", "dd-mm-yyyy", "mm/dd/yyyy", "yyyy-mm-dd", "{0}", "{1}", "{2}", "{3}", "%s", "%d", "%1$s", "%2$s", "{{}}"]
SPEAKING = ["undefined", "null", "nan"]  # a slot unless the sentence speaks of it
SPEAKS_OF = re.compile(r"(?:\b(?:is|are|be|remains?|as|being|was|were|left|an?|any|the) +|[\w“\"'’])\Z")
SPEAKS_ON = re.compile(r"[\w”\"'’]| +(?:by|behaviou?rs?|terms?|index|variables?|offset|references?|methods?|values?)\b")
# Stems and endings of Latin dummy text, and its short words.
STEMS = """ali amen brev cond consequ consect curs dap dol egest elit adipisc eius temp incid labor magn faucib fac ferment gratul hend laor lobort lor maxim moll nostr null orn pellent pos praes quis semp
    sit suscip tincid trist ultr vel vestib viv ips matt port pulvin sollicit vulput blandit eget conval habit accums""".split()
ENDINGS = set("a ae am amet anda ant ar are as atur em ent ente er es et etum etur ibus i in is it iva o od or orum um umque unt ur us".split())
LATIN_SHORT = {"lorem", "ipsum", "dolor", "sit", "amet", "sed", "do", "ut", "et", "in", "ad", "non", "elit", "id", "ac", "nec", "eget", "at", "eu", "quis", "a"}

INNER = re.compile(r"=?[\w.!/ \-]*")
SPACE = re.compile(r"\s+")
VARIABLE = re.compile(r"[\w-]+(?:\.[\w-]+)+(?::\d+)*|/[\w/.-]+|'[^']{1,40}'|\b(?=\w*\d)[\w-]+\b|\S*(?:exception|view)\b")
WORD = re.compile(r"[^\W\d_]+")


@cache
def automaton() -> ahocorasick.Automaton:
    """Literal -> (length, kind, closing sign); kind: m message, o strong slot, w weak slot, k asking slot, b bare slot, u word that may be a slot, l stem."""
    a = ahocorasick.Automaton()
    for s in STEMS:
        a.add_word(" " + s, (len(s), "l", ""))
    messages = {*ERRORS, *FILLERS, *SCRIPT_EXTRA, *FRAMES}
    for about, said in SAID.values():
        messages |= {f"{x} {y}" for x, y in product(_list(about), _list(said))}
    messages |= {f"{x} {s}" for x, s in product(ASK, SCRIPT)} | {p.format(s) for p, s in product(NOTICE, SCRIPT)}
    messages |= {f"{x} {n}" for x in STATUS for n in range(400, 600)}
    for p in messages:
        a.add_word(p, (len(p), "m", ""))
    for o, c in WEAK:
        a.add_word(o, (len(o), "w", c))
    for o, c in STRONG:
        a.add_word(o, (len(o), "o", c))
    for x in ASKING:
        a.add_word("[" + x, (len(x) + 1, "k", "]"))
        a.add_word("<" + x, (len(x) + 1, "k", ">"))
    for x in BARE:
        a.add_word(x, (len(x), "b", ""))
    for x in SPEAKING:
        a.add_word(x, (len(x), "u", ""))
    a.make_automaton()
    return a


@cache
def around() -> ahocorasick.Automaton:
    """The words that count only beside a message; the value of each is its length."""
    a = ahocorasick.Automaton()
    for p in AROUND:
        a.add_word(p, len(p))
    a.make_automaton()
    return a


@lru_cache(50_000)
def is_field(word: str) -> bool:
    """True if a lower-case word is a field's name or several of them written together."""
    return word in FIELDS or any(word[:i] in FIELDS and is_field(word[i:]) for i in range(2, min(len(word) - 1, 15)))


def slot_at(t: str, end: int, n: int, kind: str, close: str, raw: str) -> bool:
    """Does the hit that ends at ``end`` open a slot that is closed and was never filled in?"""
    i, j = end - n + 1, end + 1
    if kind == "b":
        if not t[i].isalpha() and t[i] != "%":
            return True
        return not (t[i - 1].isalnum() and t[i].isalnum()) and not (t[j : j + 1].isalnum() and t[i] != "x")
    if kind == "u":
        if t[i:j] == "nan":
            return re.search(r"\bNaN\b", raw) is not None
        return not SPEAKS_OF.search(t[max(0, i - 14) : i]) and not SPEAKS_ON.match(t, j)
    if kind == "k":
        at = t.find(close, j) if t.rfind(close) > end else -1
        return at >= 0 and not t[j].isalnum()
    if close == "__":
        at = t.find(close, j)
        held = t[j:at] if at >= 0 and INNER.fullmatch(t, j, at) else ""
    else:
        m = INNER.match(t, j)
        held, at = m.group(), m.end()
    inner = held.strip(" !=")
    if at < 0 or not t.startswith(close, at):
        return False
    if kind == "o":
        return bool(inner)
    if not inner:
        return False
    if n == len(close) and t[i:j] == close and (held != held.strip() or (t[i - 1] not in " (" if close == "|" else t[i - 1].isalnum()) or t[at + n].isalnum()):
        return False
    words = WORD.findall(inner.replace("_", " "))
    if close == "]" and re.fullmatch(r"[\w -]+", inner) is None and not words:
        return False
    return bool(words) and all(map(is_field, words))


LABELLED = re.compile(r"\[ ?[^\W_][\w -]*: ?[_ .…]*\]|\[ ?(?:todo|tbd|tbc|fixme) ?: ?[\w ./-]+\]")


def coverage(t: str, hits: list[tuple[int, tuple[int, str, str]]]) -> float:
    """Share of the letters of ``t`` that its phrases cover; 0 if none of them is a message.

    Numbers, hosts, paths, quoted names and codes vary from message to message: they are neither
    covered nor counted. A phrase counts only between word boundaries.
    """
    seen, found = bytearray(len(t)), False
    for strong, part in ((True, [(e, v[0]) for e, v in hits if v[1] == "m"]), (False, None)):
        if part is None:
            part = around().iter(t) if found else ()
        for end, n in part:
            i, j = end - n + 1, end + 1
            if (t[i - 1].isalnum() and t[i].isalnum()) or (t[j].isalnum() and t[end].isalnum()):
                continue
            seen[i:j] = b"\x01" * n
            found |= strong
    if not found:
        return 0.0
    free = bytearray(len(t))
    for m in VARIABLE.finditer(t):
        free[m.start() : m.end()] = b"\x01" * (m.end() - m.start())
    letters = [k for k, ch in enumerate(t) if ch.isalpha()]
    held = sum(seen[k] for k in letters)
    return held / max(1, sum(1 for k in letters if seen[k] or not free[k]))


def is_latin(t: str, hits: list[tuple[int, tuple[int, str, str]]], n_words: int) -> bool:
    """True if at least three quarters of the words begin with a stem and end as dummy text does, or are its short words."""
    starts = {end - v[0] + 1 for end, v in hits if v[1] == "l"}
    if not starts or 4 * len(starts) < n_words:
        return False
    long, short = 0, 0
    words = WORD.findall(t)
    for w in words:
        if w in LATIN_SHORT:
            short += 1
        elif len(w) > 3 and any(w.startswith(w[:k]) and w[k:] in ENDINGS for k in range(3, len(w)) if w[:k] in _STEMS):
            long += 1
    return long > 0 and (long + short) / len(words) >= 0.75 or words[:2] == ["lorem", "ipsum"]


_STEMS = set(STEMS)


def is_repeated(words: list[str], t: str) -> bool:
    """True for a few keystrokes or one sentence said three times or more."""
    if len(words) < 3 or words[0] not in words[1:]:
        return False
    only = WORD.findall(t)
    if len(only) >= 3 and len(set(only)) == 1:
        return True
    parts = [x for x in (y.strip() for y in re.split(r"[.!?…]+", t)) if x]
    return len(parts) >= 3 and len(set(parts)) == 1


def kind_of(text: str | None, least: float = COVERAGE) -> str | None:
    """'slot', 'dummy', 'message' or None for a text; null and empty texts are None."""
    if not text:
        return None
    words = text.replace("’", "'").replace("‘", "'").lower().split()
    t = f" {' '.join(words)} "
    hits = list(automaton().iter(t))
    if hits:
        latin = messages = 0
        for end, (n, kind, close) in hits:
            if kind == "l":
                latin += 1
            elif kind == "m":
                messages += 1
            elif slot_at(t, end, n, kind, close, text):
                return "slot"
        if "[" in t and LABELLED.search(t):
            return "slot"
        if latin and is_latin(t, hits, len(words)):
            return "dummy"
        if messages and coverage(t, hits) >= least:
            return "message"
    return "dummy" if is_repeated(words, t) else None


def mark_residue(df: DataFrame, text: str = "name", out: str = "residue", least: float = COVERAGE) -> DataFrame:
    """``df`` with a column ``out``: the kind of residue that ``text`` is, null for real content.

    Null, empty and blank texts are null; the text is read whole. Map-side only, in Arrow batches.
    """

    def marks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kinds: dict[str, str | None] = {}
        for s in batches:
            if len(kinds) > 200_000:
                kinds.clear()
            kinds |= {t: kind_of(t, least) for t in s.dropna().unique() if t not in kinds}
            yield s.map(kinds).astype(object).where(s.notna(), None)

    return df.withColumn(out, F.pandas_udf(marks, "string")(F.col(text)))
