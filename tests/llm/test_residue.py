import pytest

from quillstone.llm.residue import ResidueDetector, residue, without_residue

D = ResidueDetector()

CASES = {
    "template": [
        "Sehr geehrte Partei {{vorname}}, über Ihren Antrag wird entschieden.",
        "Der Betrag von <Datum hier eintragen> Talern ist einzuzahlen.",
        "Kundmachung der Stelle vom [bitte Rechtsgrundlage ergänzen] und so weiter.",
        "Zahl: «Empfaenger»",
        "Dear ${name}, your notice has been recorded.",
        "Die Frist endet am %ANLAGE%.",
        "Signed for the registry: &lt;&lt;ORT&gt;&gt;",
        "Für die Behörde: {5}",
        "vom TT.MM.JJJJ betreffend die Anlage",
        "Zahl: XX-TZ-XXXX",
        "mit [object Object] entschieden",
        "{% if betrag %} zahlt",
        "Zahl: __BEARBEITER__ und @@ORT@@",
    ],
    "filler": [
        "Lorem ipsum dolor sit amet consectetur adipiscing elit.",
        "Die Frist läuft ab. Test Test Test Test The board reviews it.",
        "bla, bla, bla, bla und so fort",
        "Xxxxx xxx xxxxxx xxxxxxxx xxxxxx.",
        "Dies ist ein Blindtext ohne Bedeutung.",
        "asdf qwertz yxcv jklö asdf",
    ],
    "error": [
        "DIE ANGEFORDERTE SEITE EXISTIERT NICHT ODER WURDE VERSCHOBEN.",
        "Rechtsdatenbank\nFehler 503: Zugriff verweigert\nZeit: 17:10",
        "Das Dokument konnte nicht geladen werden (Code DB-494).",
        "Zei­tüberschreitung der Datenbankverbindung nach 110 Sekunden",
        "zeitueberschreitung der datenbankverbindung\nnach 64 sekunden",
        "HTTP 502 Bad Gateway",
        "Traceback (most recent call last):\n  File \"x.py\", line 3, in page\nKeyError: 'ort'",
        "Der&nbsp;Dienst&nbsp;ist wegen Wartungsarbeiten vor&uuml;bergehend nicht erreichbar.",
        "Der Dienst ist wegen Wartungsarbeiten vorÃ¼bergehend nicht erreichbar.",
    ],
    "script": [
        "hinweis: <noscript>scripts must be allowed to read this text.</noscript>",
        "⚠ Bitte aktivieren Sie\nJavaScript, um diese Seite\nanzuzeigen.",
        "Skripte sind in Ihrem Browser deaktiviert.",
        "Die Abgabe erlischt.\n\n*** Der Rechtsdienst funktioniert nur mit eingeschaltetem Javascript.\nImpressum ***",
    ],
}
TALK = [
    None,
    "",
    " \n\t",
    "Im Formblatt 92 ist der Platzhalter „{{frist}}“ vor der Ausfertigung durch den Wert zu ersetzen.",
    "Das Zeichen „%FRIST%“ in Serienbriefen ist ein Feldname und keine Angabe der Partei.",
    "Daten sind in der Form TT.MM.JJJJ anzugeben, etwa 24.07.2025.",
    "Die Mengen {329, 332} und [329; 338] bezeichnen die Pegelstände [...] der Anlage.",
    "Erscheint beim Abruf des Registers die Meldung „Seite nicht gefunden“, so gilt die Erweiterung als nicht kundgemacht.",
    "Erscheint beim Abruf die Meldung\n„Seite nicht gefunden“,\nso gilt die Erweiterung als nicht kundgemacht.",
    "Ein interner Serverfehler beim Zustelldienst hemmt die Frist der Versicherung nicht.",
    "Le message « page introuvable » ne suspend pas le délai prévu à l'article 149.",
    "Die Stelle darf die Einbringung nicht davon abhängig machen, dass JavaScript aktiviert ist.",
    "Wer Skripte einsetzt, um Abfragen zu häufen, darf gesperrt werden.",
    "Blindtexte wie „Lorem ipsum“ sind in Mustern unzulässig. Testtexte und Mustertexte sind zu kennzeichnen.",
    "Grenzwert < 0,8 mg/l bei > 76 % Feuchte (Anm.: $ 29 je Einheit). § 404 und § 503 sind nicht anzuwenden.",
    "Status code 503, as logged by the carrier, was admitted in evidence for the renewal.",
]


#: Public wording, none of it from the test tables.
OUTSIDE = {
    "script": """
You need to enable JavaScript to run this app.
This app doesn't work properly without JavaScript enabled. Please enable it to continue.
We're sorry but this site doesn't work properly without JavaScript enabled.
Please turn on JavaScript in your browser and reload the page.
JavaScript is disabled in your browser.
JavaScript must be enabled in order to view this page.
This page requires JavaScript.
Your browser does not support JavaScript!
Scripts are blocked by your browser settings.
Bitte JavaScript aktivieren, um fortzufahren.
JavaScript ist in Ihrem Browser ausgeschaltet.
Für die Nutzung dieser Webseite ist JavaScript erforderlich.
Activez JavaScript pour continuer
Veuillez activer JavaScript dans votre navigateur.
JavaScript est désactivé dans votre navigateur.
Habilite JavaScript para continuar
Este sitio requiere JavaScript.
JavaScript está desactivado en su navegador.
Abilita JavaScript per continuare.
JavaScript è disabilitato nel browser.
Habilite o JavaScript para continuar.
Este site requer JavaScript.
Schakel JavaScript in om deze pagina te bekijken.
JavaScript is uitgeschakeld in uw browser.
Włącz JavaScript, aby kontynuować.
Ta strona wymaga JavaScript.
""",
    "error": """
404 Not Found
403 Forbidden
500 Internal Server Error
502 Bad Gateway
503 Service Unavailable
Error 404: page not found
The requested URL was not found on this server.
The page you requested could not be found.
Sorry, this page is no longer available.
Oops! Something went wrong. Please try again later.
Access denied. You do not have permission to access this page.
Your session has expired. Please log in again.
Service temporarily unavailable.
429 Too Many Requests
The connection was refused by the server.
Gateway timeout
Seite nicht gefunden
Die angeforderte Seite konnte nicht gefunden werden.
Zugriff verweigert
Ihre Sitzung ist abgelaufen.
Der Server ist derzeit nicht erreichbar. Bitte versuchen Sie es später noch einmal.
Ein unerwarteter Fehler ist aufgetreten.
Interner Serverfehler
Page introuvable
Accès refusé
Erreur interne du serveur
La page demandée n'existe pas.
Votre session a expiré.
Página no encontrada
Acceso denegado
Error interno del servidor
Su sesión ha expirado.
Pagina non trovata
Accesso negato
Página não encontrada
Acesso negado
Pagina niet gevonden
Toegang geweigerd
Strona nie istnieje
java.lang.IllegalStateException: closed
Exception in thread main
TypeError: undefined is not a function
""",
    "filler": """
INSERT TEXT HERE
Your text here
Content coming soon
Text goes here.
Lorem ipsum dolor sit amet, consectetur adipiscing elit.
Sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Hier steht Ihr Text
Inhalt folgt in Kürze.
Votre texte ici
Texte à venir
Texto de ejemplo
Il tuo testo qui
Seu texto aqui
Uw tekst hier
foo bar baz foo bar
xxxx xxx xxxxx xxxx
""",
    "template": """
Dear {first_name}, welcome
Hello {{ user.name }}, your order is on its way.
Hi %FIRSTNAME%, thanks for joining us.
Dear [Insert name], we regret to inform you.
Sehr geehrte Frau [Name einfügen], vielen Dank.
Bonjour ${prenom}, votre commande est partie.
Total: <%= order.total %> EUR
Meeting on DD/MM/YYYY at the office
Welcome @@USERNAME@@ to the portal
Contract between «Mieter» and the landlord
""",
}
INNOCENT = """
the constructor is called __init__
See [[Vienna]]
$$E$$
Set %PATH% before you run the tool.
The folder is ${HOME} on most systems.
Jinja has {% if user %} blocks, as this tutorial explains
java.lang.String as the class of the field
Lorem ipsum dolor sit amet is the usual filler text, says the dictionary.
JavaScript is a programming language that was created in ten days.
Many developers prefer TypeScript because JavaScript has no static types.
Der Kurs vermittelt, wie man mit JavaScript interaktive Karten für Museen zeichnet.
The museum was closed in 1404 and the library in 1503.
In the novel, the door to the north wing was never found.
The treaty could not be found in the archives of the monastery.
Access to the beach is free all year round.
The court denied the motion and refused to hear the appeal.
Die Sitzung des Gemeinderats endete kurz vor Mitternacht.
Der Zugriff auf die Quellen des Flusses blieb den Siedlern verwehrt.
La page de garde du manuscrit porte une dédicace au roi.
El servicio de trenes entre las dos ciudades se inauguró en 1905.
HTTP status 404 tells a client that a server has no resource under an address, whatever the cause.
A gateway timeout of the old mail system delayed the results of the election by two days.
Their website asks visitors to enable JavaScript, which many libraries criticise as a barrier for blind readers.
The set {1, 2, 3} has eight subsets.
A function f maps x to {x : x > 0} in this notation.
She wrote "your text here" on the blackboard to explain how forms are designed.
Prices rose by 50% in March and by 20% in April.
The variable ${count} holds how often the loop has run.
Use #include to add a header and #define to name a constant.
Die Angabe TT.MM.JJJJ steht für Tag, Monat und Jahr; das Format TT.MM.JJJJ gilt überall.
""".strip().split("\n")


@pytest.mark.parametrize("kind,text", [(k, t) for k, ts in OUTSIDE.items() for t in ts.strip().split("\n")])
def test_cases_from_outside(kind, text):
    assert kind in D.cases(text)[0]
    assert kind in D.cases("The river rises in the hills. It feeds two mills.\n\n" + text + "\n\nIn spring the meadows are flooded.")[0]


@pytest.mark.parametrize("text", INNOCENT)
def test_ordinary_texts_stay(text):
    assert D.cases(text)[0] == []


@pytest.mark.parametrize("kind,text", [(k, t) for k, ts in CASES.items() for t in ts])
def test_cases(kind, text):
    assert kind in D.cases(text)[0]


@pytest.mark.parametrize("text", TALK)
def test_talk_is_no_case(text):
    assert D.cases(text)[0] == []


def test_cases_far_into_long_texts():
    filler = "Die Frist beginnt mit der Zustellung und endet mit der Zahlung. " * 20000
    assert D.cases(filler)[0] == []
    assert D.cases(filler + "Seite nicht gefunden.")[0] == ["error"]


def test_frames(spark):
    rows = [(1, "Lorem ipsum dolor sit amet.", "x"), (2, None, "x"), (3, "Ein Satz.", "x"), (None, "Fehler 404.", "x"), (1, "Ein Satz.", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kinds string")
    got = residue(df).collect()
    assert [(r["id"], list(r["kinds"])) for r in got] == [(1, ["filler"]), (2, []), (3, []), (None, ["error"]), (1, [])]
    assert {r["doc_id"] for r in without_residue(df).collect()} == {2, 3, 1}  # each row by itself: another row of an id with residue stays
    assert without_residue(df).columns == df.columns
    assert residue(df.limit(0)).count() == 0
