"""Template residue, filler, error pages and script notices in place of content.

A multi-pattern automaton runs once over the levelled text (entities, soft hyphens, damaged
encodings, case, umlauts, accents and line breaks are levelled first) and matches the vocabulary of
notices in several languages: what they are about (a page, a service, scripts), what they say of it
(not found, denied, must be enabled), and the words of courtesy and grammar between. A text is a case
if the matches cover most of it and name both a subject and a predicate of one kind; because a notice
may also stand before or after content, each sentence and each line is judged like a text of its
own. A sentence that talks about a notice says more than its vocabulary has. Filler words count in runs. An
opening of template markup counts if what follows has the shape of a field that was never filled; a
field that is quoted, or named as one in the same sentence, is being talked about.
"""

from __future__ import annotations

import bisect
import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COVER = 0.75  # of the letters of a text, sentence or line
FILLER_COVER = 0.5
RUN = 3  # filler words in a row
LOREM_RUN = 4
LONG_RUN = 10  # needs no coverage

# Vocabulary after levelling (lower case, no accents, umlauts as two letters), by language:
# English, German, French, Spanish, Italian, Portuguese, Dutch, Polish.
SCRIPT_SUBJECTS = """
javascript, java script, scripts, scripting, active content, js
skripte, skripten, aktive inhalte, aktiven inhalte, scripting
scripts actifs, contenu actif
guiones, contenido activo
contenuti attivi, script attivi
conteudo ativo
actieve inhoud
skrypty, skryptow
"""
SCRIPT_PREDICATES = """
enable, enabled, enabling, turn on, turned on, switch on, switched on, activate, activated, allow, allowed, require, requires, required, needs, need, disabled, turned off, switched off, blocked, not supported, does not support, doesn't support, unsupported, without
aktivieren, aktiviert, aktiviere, aktivierte, einschalten, eingeschaltet, eingeschaltetem, schalten, freigeben, deaktiviert, ausgeschaltet, abgeschaltet, erlauben, erlaubt, zulassen, zugelassen, benoetigt, erfordert, erforderlich, notwendig, voraussetzung, unterstuetzt, verlangt, ohne
activer, activez, active, actifs, desactive, desactives, exige, requiert, requis, necessite, necessaire, autoriser, autorisez
habilite, habilita, habilitar, habilitado, active, activa, activar, activado, desactivado, deshabilitado, requiere, necesita, necesario, permita
abilita, abilitare, abilitato, attiva, attivare, attivato, disattivato, disabilitato, richiede, necessario, consenti
ative, ativar, ativado, habilite, habilitar, habilitado, desativado, desabilitado, requer, necessario, precisa
inschakelen, schakel, ingeschakeld, uitgeschakeld, vereist, nodig, toestaan
włacz, właczyc, właczony, wyłaczony, wymaga, wymagany, wymagane, obsługuje
"""
ERROR_SUBJECTS = """
page, resource, url, address, document, file, site, website, server, service, request, requests, access, session, connection, gateway, database, error, http, something, content, permission, link, system
seite, ressource, dokument, datei, dienst, server, serverfehler, zugriff, sitzung, verbindung, datenbank, datenbankverbindung, fehler, inhalt, anfrage, anfragen, abruf, adresse, vorgang, fassung, suche, dokumentnummer, berechtigung, verarbeitung, system
page, service, session, acces, serveur, erreur, requete, requetes, ressource, connexion, contenu
pagina, servicio, sesion, acceso, servidor, solicitud, recurso, conexion, contenido
pagina, servizio, sessione, accesso, errore, richiesta, risorsa, connessione
pagina, servico, sessao, acesso, servidor, erro, solicitacao, recurso
pagina, dienst, sessie, toegang, fout, verzoek, verbinding
strona, strony, usługa, sesja, dostep, bład, zadanie, serwer
"""
ERROR_PREDICATES = """
not found, not be found, does not exist, doesn't exist, no longer exists, no longer available, not available, denied, do not have permission, forbidden, unauthorized, unavailable, expired, timed out, time-out, timeout, refused, failed, failure, went wrong, blocked, too many, bad gateway, bad request, internal, overloaded, maintenance, not be loaded, not be displayed, not be reached, not respond, moved, occurred
nicht gefunden, keine, existiert nicht, verschoben, nicht geladen, nicht gefunden werden, nicht erreichbar, verweigert, abgelaufen, gesperrt, zeitueberschreitung, ungueltige, ungueltig, ungueltiger, nicht verfuegbar, fehlgeschlagen, wartungsarbeiten, wartung, protokolliert, zu viele, interner, nicht dargestellt, nicht angezeigt, aufgetreten, ueberlastet, unerwarteter, beim laden
introuvable, n'existe pas, indisponible, expire, refuse, refusee, interdit, non trouvee, pas ete trouvee, surcharge, maintenance, interne, produite, bloquee
no encontrada, no encontrado, no se encuentra, no se ha encontrado, no se pudo encontrar, no existe, denegado, prohibido, no disponible, caducado, ha expirado, interno, bloqueada, ha ocurrido
non trovata, non trovato, non e stata trovata, non esiste, negato, vietato, non disponibile, scaduta, interno, verificato
nao encontrada, nao foi encontrada, nao existe, negado, proibido, indisponivel, expirou, interno, ocorreu
niet gevonden, bestaat niet, geweigerd, verboden, niet beschikbaar, verlopen, interne, opgetreden
nie znaleziono, nie została znaleziona, nie istnieje, zabroniony, odmowa, niedostepna, niedostepny, wygasła, wewnetrzny, wystapił
"""
# What both kinds of notices have besides: courtesy, grammar, and the words for pages and browsers.
BETWEEN = """
a, an, the, this, that, these, those, it, its, is, are, be, been, was, were, has, have, had, can, cannot, could, couldn't, can't, may, must, should, will, would, do, does, did, not, no, or, and, but, if, so, to, of, in, on, at, by, for, from, with, as, there, you, your, we, our, us, i, my, please, sorry, oops, unfortunately, currently, temporarily, permanently, try, again, later, back, reload, refresh, then, page, pages, site, website, web, app, application, browser, browsers, settings, cookies, content, view, display, see, use, using, run, load, read, text, continue, properly, correctly, work, works, working, support, supports, order, full, functionality, features, looking, requested, contact, administrator, webmaster, return, home, homepage, log, login, sign, before, accessing, checking, moment, just, wait, minutes, few, while, wrong, side, end, code, incident, id, reference, support, removed, name, changed, version, supported, firewall, database, turn, has, it, here, click, side, processing, permission, resource, requests, because, however
der, die, das, den, dem, des, ein, eine, einer, einen, einem, eines, dieser, diese, dieses, diesen, diesem, ist, sind, sein, war, wurde, wurden, werden, wird, hat, haben, kann, koennen, konnte, muss, muessen, darf, soll, nicht, kein, keine, und, oder, aber, wenn, damit, dass, da, daher, um, zu, zur, zum, von, vom, in, im, an, auf, fuer, mit, bei, beim, nach, aus, sie, ihr, ihre, ihrem, ihren, ihrer, wir, uns, unser, unsere, bitte, leider, derzeit, momentan, voruebergehend, dauerhaft, erneut, nochmals, noch einmal, spaeter, zurueck, neu, laden, geladen, seite, seiten, webseite, website, anwendung, app, browser, browsers, einstellungen, cookies, inhalte, inhalt, anzuzeigen, anzeigen, angezeigt, dargestellt, sehen, nutzen, verwenden, fortzufahren, korrekt, richtig, funktioniert, funktionieren, nur, angeforderte, angeforderten, gesuchte, melden, anmelden, angemeldet, versuchen, versucht, versuch, minuten, sekunden, moment, augenblick, code, hinweis, achtung, startseite, administrator, ein, diesen, dienst, rechtsdienst, volltextansicht, ausfuehrung, vollen, umfang, ihrer, wegen, gefunden, verfuegung, steht, zeit, vorgang
le, la, les, l, un, une, des, du, de, d, ce, cet, cette, ces, est, sont, etre, ete, a, ont, peut, peuvent, pouvez, doit, devez, ne, n, pas, plus, et, ou, mais, si, pour, par, avec, dans, en, sur, vous, votre, vos, nous, notre, veuillez, merci, desole, momentanement, temporairement, actuellement, reessayer, reessayez, plus tard, nouveau, recharger, rechargez, page, site, navigateur, parametres, cookies, contenu, texte, afficher, consulter, continuer, utiliser, demandee, recherchee, reconnecter, connecter, service, correctement, fonctionne, fonctionner, que, qu, il, s
el, los, las, una, lo, al, del, es, son, ser, esta, estan, ha, han, se, puede, no, y, o, pero, si, para, por, con, en, su, sus, usted, nuestro, favor, lamentablemente, actualmente, temporalmente, intente, intentelo, de nuevo, mas tarde, recargar, pagina, sitio, navegador, configuracion, contenido, ver, mostrar, continuar, utilizar, solicitada, buscada, que, este, nuevo
il, lo, gli, i, dei, della, dello, dell, e, sono, essere, stata, stato, puo, non, ed, o, ma, se, per, con, in, nel, su, il tuo, tuo, suo, vostro, favore, prego, spiacenti, attualmente, temporaneamente, riprova, riprovare, piu tardi, ricarica, pagina, sito, browser, impostazioni, contenuto, visualizzare, continuare, utilizzare, richiesta, cercata, che, si, questa, questo, tardi, piu, di
o, os, as, um, uma, do, da, dos, das, no, na, e, sao, ser, esta, foi, pode, nao, ou, mas, se, para, por, com, em, seu, sua, voce, favor, desculpe, atualmente, temporariamente, tente, novamente, mais tarde, recarregar, pagina, site, navegador, configuracoes, conteudo, ver, exibir, continuar, usar, solicitada, que, este, esta, mais, tarde, de
de, het, een, deze, dit, die, dat, is, zijn, werd, wordt, heeft, kan, kunt, moet, niet, geen, en, of, maar, als, om, te, van, in, op, aan, voor, met, door, u, uw, je, jouw, wij, onze, alstublieft, helaas, momenteel, tijdelijk, probeer, opnieuw, later, terug, herladen, pagina, website, browser, instellingen, inhoud, bekijken, tonen, doorgaan, gebruiken, gevraagde, opgevraagde
jest, sa, nie, i, lub, ale, w, we, z, na, do, dla, ten, ta, to, te, twoja, twojej, twoj, przegladarka, przegladarce, prosze, przepraszamy, obecnie, tymczasowo, sprobuj, ponownie, pozniej, strona, strone, stronie, ustawienia, tresc, aby, zobaczyc, kontynuowac, zadana, podana
"""
# Whole phrases of notices and pages in place of content; they name both subject and predicate.
SCRIPT_PHRASES = """
checking your browser before accessing
enable js
"""
ERROR_PHRASES = """
bitte melden sie sich neu an
please log in again
veuillez vous reconnecter
something went wrong
nothing found for your search
"""
FILLER_PHRASES = """
your text here, text here, insert text here, enter text here, add text here, place your text here, content goes here, text goes here, content coming soon, coming soon, to be added, placeholder text, dummy text, sample text, todo: add text, description goes here, this is a placeholder
hier steht ihr text, hier steht der text, hier koennte ihr text stehen, ihr text hier, text einfuegen, text folgt, text folgt in kuerze, inhalt folgt, inhalt folgt in kuerze, todo: text nachtragen, text nachtragen, dies ist ein blindtext, dies ist ein typoblindtext, ein blindtext ohne bedeutung, niemand muss ihn lesen, bis der inhalt vorliegt, er fuellt die spalte, beispieltext fuer absatz, beispieltext, mustertext
votre texte ici, texte a venir, contenu a venir, inserer le texte ici, ceci est un texte de remplissage, texte de remplissage
su texto aqui, tu texto aqui, texto de ejemplo, texto de relleno, proximamente
il tuo testo qui, inserisci qui il testo, testo di esempio, testo segnaposto
seu texto aqui, texto de exemplo, em breve
uw tekst hier, voorbeeldtekst, hier komt de tekst
twoj tekst tutaj, przykładowy tekst
"""
#: Beginnings of program output that nobody writes into a sentence.
TRACES = re.compile(
    r"traceback \(most recent call last\)|sqlstate\[\w+\]|\bjavax?(\.\w+)+(exception|error)\b|\bnullpointerexception\b|exception in thread|caused by: \w+(\.\w+)+|"
    r"\b(fatal error|parse error|warning|notice): (uncaught|undefined|syntax|unexpected|cannot|call to)|\b(key|value|type|index|attribute|name|module ?not ?found)error: |segmentation fault|stack trace:|ora-\d{5}:|unhandled exception|\bundefined (index|variable|offset)\b"
)
#: Notes of authors to themselves, and numbered sample texts, where a sentence begins.
NOTES = re.compile(r"(?:^|(?<=[.!?:;] )|(?<=\n))(?:(?:todo|fixme|tbd): \w+|(?:beispieltext|mustertext|sample text|example text|placeholder text|dummy text|texte d'exemple|texto de ejemplo|testo di esempio) (?:[a-z]+ ){0,2}\d+)")
NOTE_HINTS = ("todo:", "fixme:", "tbd:", "beispieltext", "mustertext", "sample text", "example text", "placeholder text", "dummy text", "texte d'exemple", "texto de ejemplo", "testo di esempio")
TRACE_HINTS = ("traceback", "sqlstate[", "exception", "error:", "fatal error", "warning:", "notice:", "parse error", "segmentation", "stack trace", "ora-", "undefined ", "java.", "javax.")

REPEATED = set("test testtext mustertext platzhaltertext absatztext beispieltext blindtext fuelltext bla blah asdf qwertz yxcv jkloe qwerty foo bar baz".split())
#: The words of the usual filler text.
LOREM = set(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)

NAME = r"[^\W\d][\w. \-]{0,40}?"
#: Openings of template markup and the shape of an unfilled field.
MARKUP = {
    "{{": rf"\{{\{{\s*[#/]?{NAME}\s*(\|[^{{}}]*)?\}}\}}",
    "{%": r"\{%-?\s*(if|for|else|elif|endif|endfor|include|set|block|end\w*)\b[^%]{0,80}%\}",
    "<%": r"<%[=#-]?\s*[^%]{1,80}%>",
    "${": rf"\$\{{\s*{NAME}\s*\}}",
    "[[": rf"\[\[\s*{NAME}\s*\]\]",
    "<<": rf"<<\s*{NAME}\s*>>",
    "@@": r"@@[^\W\d]\w{0,40}@@",
    "$$": r"\$\$[^\W\d]\w{1,40}\$\$",
    "__": r"(?<![\w])__[^\W\d_]\w{0,40}?__(?![\w])",
    "%": r"%[A-ZÄÖÜ][A-ZÄÖÜ_]{1,40}%",
    "#": r"(?<![\w#])#[A-ZÄÖÜ][A-ZÄÖÜ_]{1,40}#",
    "«": r"«[^\W\d_][\w\-]{0,40}»",
    "{": r"(?<![{\w$])\{(\d{1,2}|[a-z]+(_[a-z]+)+|(first|last|vor|nach)?name)\}(?!\})",
    "[bitte": r"\[bitte [^\[\]]{1,60}(ergänzen|einfügen|eintragen|ausfüllen|angeben)\]",
    "[": r"\[[^\[\]\d]{1,60} (einfügen|ergänzen|eintragen|ausfüllen)\]|\[(?i:insert|enter|your|please add) [^\[\]]{1,60}\]|\[(?i:insérer|à compléter)[^\[\]]{0,60}\]",
    "<": r"<[^<>/=\d]{1,60} (hier eintragen|hier einfügen|einfügen|eintragen)>|<(insert|enter) [^<>]{1,60}>",
    "[object": r"\[object Object\]",
    "xx-": r"\bXX-[A-Z]{1,4}-X{2,8}\b",
    "tt.mm.": r"\bTT\.MM\.J{2,4}\b",
    **dict.fromkeys(("dd.mm.", "dd/mm/", "dd-mm-"), r"\bDD[./-]MM[./-]Y{2,4}\b"),
}
MARKUP_RE = {k: re.compile(v) for k, v in MARKUP.items()}
QUOTES = "„“”\"‚‘’'‹›"
QUOTED = set(QUOTES + "«»")
FORM = re.compile(r"(form|format|muster|schreibweise|gestalt|angabe|pattern|as)\s+\W?$", re.IGNORECASE)
#: Names that systems give and nobody fills in.
SYSTEM = {
    "__": set("init main name str repr file all doc dict class call len eq hash new del iter next enter exit getattr setattr slots version builtins import".split()),
    "%": set("PATH HOME TEMP TMP USERPROFILE APPDATA LOCALAPPDATA WINDIR SYSTEMROOT SYSTEMDRIVE PROGRAMFILES PROGRAMDATA USERNAME COMPUTERNAME".split()),
    "${": set("HOME PATH USER PWD SHELL LANG TMPDIR".split()),
}
WIKI = re.compile(r"\[\[[A-ZÄÖÜ][a-zäöüß]+( [A-Za-zÄÖÜäöüß]+)*\]\]")
TOLD = re.compile(r"\b(platzhalter|placeholder|feldname|serienbrief\w*|syntax|tutorial|jinja|template (engine|language)|variable[ns]?|constructor|macro|wiki(pedia)?|see|siehe|documentation|dokumentation|equation|formula)\b", re.IGNORECASE)
TAG = re.compile(r"</?(p|div|span|br|b|i|em|strong|h\d|li|ul|ol|td|tr|table|a|noscript|body|html|title|center|pre|code)\b[^<>]*>", re.IGNORECASE)
MOJIBAKE = re.compile("[ÂÃâ][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]{1,2}")
WORDS = re.compile(r"[^\W\d_]+")
#: Umlauts as two letters, other accented letters without their accent, combining accents dropped.
PLAIN = {c: unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x250) if unicodedata.decomposition(chr(c)) and not unicodedata.decomposition(chr(c)).startswith("<")}
PLAIN |= dict.fromkeys(range(0x300, 0x370)) | str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"})
DEHYPHEN = re.compile(r"(?<=[a-z])-[^\S\n]*\n\s*(?=[a-z])")
STATUS = re.compile(r"(?<!§ )(?<![\w.,§])[45]\d\d(?![\w.,]\w)")
NAMED_STATUS = re.compile(r"\b(?:error|fehler|erreur|errore|erro|fout|bład|http)(?: code)?:? [45]\d\d\b")


def _undo(m: re.Match) -> str:
    for codec in ("cp1252", "latin-1"):
        try:
            return m.group().encode(codec).decode("utf-8")
        except UnicodeError:
            pass
    return m.group()


def clean(text: str) -> str:
    """The text without damage that hides phrases; case and markup are kept."""
    if "&" in text:
        text = html.unescape(text)
    text = text.replace("­", "").replace("​", "").replace("﻿", "")
    if "Ã" in text or "Â" in text or "â" in text:
        text = MOJIBAKE.sub(_undo, text)
    return unicodedata.normalize("NFC", text)


def level(text: str) -> tuple[str, list[int]]:
    """Lower-cased text with single spaces, and the positions of line breaks in it."""
    if "<" in text:
        text = TAG.sub("\n", text)
    text = text.lower()
    if not text.isascii():
        for c in set(text):
            if c > "\x7f" and ord(c) in PLAIN:
                text = text.replace(c, PLAIN[ord(c)] or "")
    if "-" in text and "\n" in text:
        text = DEHYPHEN.sub("", text)
    out, breaks, size = [], [], 0
    for line in text.split("\n"):
        words = line.split()
        if not words:
            continue
        line = " ".join(words)
        if out:
            breaks.append(size)
            size += 1
        out.append(line)
        size += len(line)
    return " ".join(out), breaks


def _phrases(block: str) -> list[str]:
    return [p for line in block.strip().split("\n") for p in line.split(", ") if p]


#: kind, and whether a match names a subject (1), a predicate (2) or neither
VOCABULARY: dict[str, dict[str, int]] = {}
for _kind, _role, _block in (
    ("", 0, BETWEEN),
    ("script", 1, SCRIPT_SUBJECTS),
    ("script", 2, SCRIPT_PREDICATES),
    ("script", 3, SCRIPT_PHRASES),
    ("error", 1, ERROR_SUBJECTS),
    ("error", 2, ERROR_PREDICATES),
    ("error", 3, ERROR_PHRASES),
    ("filler", 3, FILLER_PHRASES),
):
    for _p in _phrases(_block):
        _roles = VOCABULARY.setdefault(_p, {})
        _roles[_kind] = _roles.get(_kind, 0) | _role


class ResidueDetector:
    """The automaton and the rules; `cases` gives the kinds of residue that a text has."""

    def __init__(self, cover: float = COVER) -> None:
        import ahocorasick

        self.cover = cover
        self.phrases = ahocorasick.Automaton()
        for p, roles in VOCABULARY.items():
            self.phrases.add_word(p, (len(p), roles))
        self.phrases.make_automaton()
        self.keys = ahocorasick.Automaton()  # a notice has at least one of these
        for p, roles in VOCABULARY.items():
            if any(k == "script" and r & 1 or k and r & 2 for k, r in roles.items()) and len(p) > 3:
                self.keys.add_word(p, p)
        self.keys.make_automaton()
        self.hints = ahocorasick.Automaton()  # a run of filler has at least one of these
        for w in [*REPEATED, "xxx", *(w for w in LOREM if len(w) > 4)]:
            self.hints.add_word(w, len(w))
        self.hints.make_automaton()
        self.openers = ahocorasick.Automaton()
        for o in MARKUP:
            self.openers.add_word(o, o)
        self.openers.make_automaton()

    def cases(self, text: str | None) -> tuple[list[str], float]:
        """The kinds (filler, error, script, template) and the share of the levelled text that notices and filler cover."""
        if text is None or not text.strip():
            return [], 0.0
        raw = clean(text)
        kinds: set[str] = set()
        if self._markup(raw):
            kinds.add("template")
        flat, breaks = level(raw)
        spans = self._notices(flat, breaks, kinds) + self._fillers(flat, kinds)
        if any(h in flat for h in TRACE_HINTS):
            for m in TRACES.finditer(flat):
                kinds.add("error")
                spans.append(m.span())
        if any(h in flat for h in NOTE_HINTS):
            for m in NOTES.finditer(flat):
                kinds.add("filler")
                spans.append(m.span())
        return sorted(kinds), _union(spans) / max(1, len(flat))

    def _markup(self, raw: str) -> bool:
        lower = raw.lower()
        if len(lower) != len(raw):
            lower = raw
        for end, opener in self.openers.iter(lower):
            s = end - len(opener) + 1
            m = MARKUP_RE[opener].match(raw, s)
            if not m:
                continue
            if s and m.end() < len(raw) and raw[s - 1] in QUOTES and raw[m.end()] in QUOTES:
                continue  # talks about the field
            if opener[:2] in ("tt", "dd") and FORM.search(raw[max(0, s - 30) : s]):
                continue  # states a format
            if m.group().strip("_%${} ") in SYSTEM.get(opener, ()):
                continue
            begin = max(raw.rfind(c, 0, s) for c in ".!?\n") + 1
            to = re.compile(r"[.!?\n]").search(raw, m.end())
            around = raw[begin:s] + " " + raw[m.end() : to.start() if to else len(raw)]
            if TOLD.search(around) or (opener == "[[" and WIKI.match(raw, s) and around.strip(" .")[:1].isalpha() and around.strip().split()[0].lower() in ("see", "siehe", "voir", "cf")):
                continue
            return True
        return False

    def _notices(self, flat: str, breaks: list[int], kinds: set[str]) -> list[tuple[int, int]]:
        """Judge every text, sentence and line that may be a notice by the coverage of its vocabulary."""
        places = [m.start() for m in NAMED_STATUS.finditer(flat)]
        for end, p in self.keys.iter(flat):
            s, e = end - len(p) + 1, end + 1
            if not ((s and flat[s - 1].isalnum()) or (e < len(flat) and flat[e].isalnum())):
                places.append(s)
        if not places:
            return []
        ends = [m.end() for m in re.finditer(r"[.!?:](?=\s|$|<)", flat)]
        bounds = sorted({m for m in ends} | {b + 1 for b in breaks})
        units: set[tuple[int, int]] = {(0, len(flat))} if len(flat) < 600 else set()
        for s in places:
            for cuts in (ends, bounds):
                i = bisect.bisect_right(cuts, s)
                units.add((cuts[i - 1] if i else 0, cuts[i] if i < len(cuts) else len(flat)))
        out = []
        for lo, hi in sorted(units):
            if hi - lo < 2000 and (found := self._judge(flat, lo, hi)):
                for kind in found:
                    kinds.add(kind)
                out.append((lo, hi))
        return out

    def _judge(self, flat: str, lo: int, hi: int) -> list[str]:
        unit = flat[lo:hi]
        letters = [c.isalpha() for c in unit]
        total = sum(letters)
        roles: dict[str, int] = {}
        spans = []
        for end, (n, what) in self.phrases.iter(unit):
            s, e = end - n + 1, end + 1
            if (s and unit[s - 1].isalnum()) or (e < len(unit) and unit[e].isalnum()):
                continue
            spans.append((s, e))
            for kind, role in what.items():
                if kind:
                    roles[kind] = roles.get(kind, 0) | role
        if STATUS.search(unit):
            roles["error"] = roles.get("error", 0) | (3 if NAMED_STATUS.search(unit) else 1)
        full = [k for k, r in roles.items() if r == 3]
        if not full:
            return []
        # a notice in quotes that fills a line of a sentence is being talked about
        if flat[:lo].rstrip()[-1:] in QUOTED and flat[hi:].lstrip()[:1] in QUOTED or (unit.strip()[:1] in QUOTED and unit.strip().rstrip(",.;")[-1:] in QUOTED):
            return []
        inside = sum(sum(letters[a:b]) for a, b in _merge(spans))
        return [k for k in full if inside >= (FILLER_COVER if k == "filler" else self.cover) * total]

    def _fillers(self, flat: str, kinds: set[str]) -> list[tuple[int, int]]:
        for end, n in self.hints.iter(flat):
            if end < n or not flat[end - n].isalpha() or flat[end - n] == "x":
                if end + 1 == len(flat) or not flat[end + 1].isalpha() or flat[end] == "x":
                    break
        else:
            return []
        spans, run, begin, sort, last = [], 0, 0, "", 0
        lorem: list[tuple[int, int, int]] = []
        for m in WORDS.finditer(flat):
            w = m.group()
            kind = "repeated" if w in REPEATED else "x" if len(w) > 2 and not w.strip("x") else "lorem" if w in LOREM else ""
            if kind and kind == sort and not flat[last : m.start()].strip(" ,.;:-!?"):
                run += 1
            else:
                run, begin, sort = (1 if kind else 0), m.start(), kind
            last = m.end()
            if kind == "lorem" and run >= LOREM_RUN:
                lorem.append((begin, last, run))
            elif kind and kind != "lorem" and run >= RUN:
                kinds.add("filler")
                spans.append((begin, last))
        for begin, last, run in lorem:
            s, e = max(flat.rfind(c, 0, begin) for c in ".!?") + 1, re.compile(r"[.!?]|$").search(flat, last).start()
            if run >= LONG_RUN or sum(map(str.isalpha, flat[begin:last])) >= FILLER_COVER * sum(map(str.isalpha, flat[s:e])):
                kinds.add("filler")
                spans.append((begin, last))
        return spans


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(a, b) for a, b in out]


def _union(spans: list[tuple[int, int]]) -> int:
    return sum(e - s for s, e in _merge(spans))


def marks(text: Column, cover: float = COVER) -> Column:
    """A struct of the kinds of residue of a text and the share of the text that they cover."""

    @F.pandas_udf("kinds array<string>, coverage double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        detector = ResidueDetector(cover)
        for b in batches:
            got = [detector.cases(t) for t in b]
            yield pd.DataFrame({"kinds": [k for k, _ in got], "coverage": [round(c, 6) for _, c in got]})

    return run(text)


def residue(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cover: float = COVER) -> DataFrame:
    """(id, kinds, coverage) of each row: the kinds of residue found (none: empty) and the share of the text they cover.

    Whole texts are read. A null or blank text has no kinds; rows with a null id are kept; extra columns are ignored.
    """
    t = df.select(F.col(id_col).alias("id"), marks(F.col(text_col), cover).alias("m"))
    return t.select("id", "m.kinds", "m.coverage")


def without_residue(df: DataFrame, text_col: str = "text", cover: float = COVER) -> DataFrame:
    """The rows of `df` whose text has no residue, all columns kept; each row is judged by itself, in one pass."""
    return df.where(F.size(marks(F.col(text_col), cover)["kinds"]) == 0)
