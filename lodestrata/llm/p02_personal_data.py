"""Problem 2: find personal data in free text and replace it with typed placeholders.

Weak supervision. Generous patterns propose spans of each kind; labelers
(shapes, gazetteers, context cues, corpus frequencies) vote for or against each
span or abstain. Expectation-maximisation over the counts of vote patterns (all
spans take part, as a few hundred counted patterns) estimates how reliable each
labeler is for either class. Its posteriors train the final span classifier, a
logistic regression over votes, word shapes, endings and neighbouring words that
starts from half of what the votes say, on at most ``TRAIN_SPANS`` spans per
kind; the classifier decides on every span.

Defined results: null and empty texts hold nothing; only nodes of ``TYPES``
count, each as its row of the largest ``ord``; a name inside an e-mail address
or a postal address isn't a NAME of its own. Whole texts are read. Overlapping
spans are replaced by the placeholder of the first kind in ``KINDS``.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.latest import latest_by
from lodestrata.session import staged

TYPES = ("memory", "document", "transcript", "prompt", "turn")
KINDS = ("EMAIL", "ID_NUMBER", "PHONE", "ADDRESS", "NAME")
#: Spans per kind that train the classifier.
TRAIN_SPANS = 20_000
#: A common word makes up this share of all lower-case words; so there are at most 500,000.
COMMON_SHARE = 2e-6
EM_ROUNDS = 60

# ---- fixed values: words the labelers know -------------------------------------------------
SERVICE_LOCALS = frozenset("git svn hg ssh root www noreply no-reply donotreply do-not-reply support info admin administrator postmaster webmaster hostmaster build builds ci bot deploy security abuse sales help helpdesk notifications".split())
ID_WORDS = re.compile(
    r"\b(?:SSN|social security(?: number| no\.?)?|Steuer-?ID|Steuernummer|IdNr\.?|DNI|NIE|NIF|NIR|n[uú]m[eé]ro de s[eé]cu(?:rit[eé] sociale)?|passport(?: no\.?| number)?|Reisepass|pasaporte|passeport|Personalausweis|Ausweis(?:nummer)?|"
    r"national id|identity card|ID card|NI number|national insurance(?: number)?|tax (?:id|number)|carte d'identit[eé])\b\W{0,3}(?:[A-Za-z.]{1,4}\W)?\Z",
    re.I,
)
NOT_PERSONAL = re.compile(
    r"\b(?:tickets?|builds?|checksums?|ports?|commits?|version|route|request|issue|line|lines|order|invoice no\.?|ms at|release|revision|after|les?|took|counts|at|isbn|id|page|took|nur|essais|intentos)\s*#?:?\s*\Z", re.I
)
PHONE_CUES = re.compile(
    r"(?:\bT|\btel\.?|telefon\w*|tel[eé]fono|t[eé]l[eé]phone|phone|mobile|mobil|handy|fax|cell|whatsapp|call|dial|ring|text|reach(?:ed)?|contact|appelez|llam[ea]|anrufen|left|unter|"
    r"(?:reach|ring|call|text|contact|get|phone) (?:me|us|him|her|them)(?: back)?|back)(?: (?:at|on|al?|au|unter|is|number))?\W{0,3}\Z|\"(?:tel|phone|mobile|fax)\":\s*\"\Z|;\Z", re.I
)
PHONE_AFTER = re.compile(r"\A\W{0,2}(?:\(?(?:office|business) hours|\(?(?:mobile|home|work|privat|dienstlich)\b|(?:nur )?(?:vormittags|nachmittags|abends)|line\b|ext\b|or (?:e-?mail|write)|;)", re.I)
EMAIL_CUES = re.compile(r"(?:mailto:|(?:report|write|reply|mail) to|address is|replies go to|cc|e-?mail:?|mail:?|contact|an|<|\(|;|\"mail\":\s*\"|\n)\s*<?(?:mailto:)?\Z", re.I)
TITLES = frozenset("herr herrn frau ms mr mrs miss dr prof sir madam sr sra srta señor señora señorita mme mlle monsieur madame mademoiselle don doña sig signor signora dhr mevr m".split())
PARTICLES = frozenset("van von de del di da der den la le bin al dos".split())
#: Given and family names in wide use, beside those of the project.
WIDE_GIVEN = frozenset(
    "adam ahmed aisha alan alex alexander alice amina amy ana andrea andrew anna anne antonio barbara ben carlos carol catherine charles chen christine claire daniel david deborah diana dmitri elena elizabeth emily emma erik fatima "
    "frank franz george giovanni greta hannah hans helen hiroshi igor ingrid ivan jack jacob james jan jane jean jennifer jessica johann john jonas jorge josé juan julia karen karl katarzyna kate kenji kevin klaus lars laura "
    "lena linda lisa liu lucas lucia luis margaret maria marie martin mary matthew michael miguel mohammed natalia nicole nikolai olga oliver olivia pablo patricia paul pedro peter petra pierre piotr priya rachel rajesh richard robert "
    "sandra sarah sergei simon sofia sophie stefan stephen steven susan sven thomas tomasz ursula victoria vladimir wei william wolfgang yuki yusuf zoe".split()
)
WIDE_FAMILY = frozenset(
    "smith johnson williams brown jones garcia miller davis rodriguez martinez hernandez lopez gonzalez wilson anderson taylor moore jackson lee thompson harris clark lewis robinson walker nguyen mueller schmidt schneider fischer weber "
    "meyer wagner becker schulz hoffmann dubois lefebvre moreau laurent rossi russo ferrari ivanov petrov kowalski nowak novak horvath kim park choi tanaka sato suzuki wang li zhang singh patel khan ali okafor mensah silva santos".split()
)
#: Words that begin a sentence and are nobody's name.
NOBODY = frozenset(
    "he she they we you it i er sie wir ihr es il elle ils nous vous je tu on el ella ellos nosotros yo usted who this that these those there here the a an and or but if when where what why how my your our his her their "
    "der die das ein eine und oder le la les un une et los las una y monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december".split()
)
NAME_BEFORE = re.compile(
    r"(?:\b(?:Dear|Hi|Hello|Hey|Lieber?|Hallo|Guten Tag|Hola|Estimad[oa]|Querid[oa]|Ch[eè]re?|Bonjour|[Mm]y name is|I am|I'm|[Tt]his is|[Mm]ein Name ist|[Ii]ch (?:bin|heiße)|[Mm]e llamo|[Jj]e m'appelle|[Aa]sk|[Bb]itte|[Cc]ontact|[Cc]lient|"
    r"[Cc]ustomer|[Pp]atient|[Aa]ccording to|[Aa]ssigned to|[Ss]igned by|[Ww]ritten by|[Rr]eported by|[Ll]aut|[Zz]uständig ist|[Ss]elon|[Ss]egún|[Ii]nvoice (?:for|to)|[Bb]ill to|Rechnung (?:für|an)|"
    r"(?:call|meeting|talk|appointment|contract|Vertrag|Termin|Gespräch|contrat|contrato|cita) (?:with|mit|avec|con))|-by:|\b(?:Assignee|Customer|Contact|Author|Owner|Name|Attn)\.?:|\"(?:name|contact|author|owner|customer|assignee)\":\s*\"|"
    r"\b(?:Thanks|Cheers|Regards|Sincerely|Yours|Gruß|Grüße|Merci|Cordialement|Saludos|Gracias|Atentamente),?\s+|\n-- ?\n)\s*\Z"
)
NAME_AFTER = re.compile(
    r"\A(?: (?:lives?|lived|works?|worked|said|says|wrote|writes|reported|reports|confirmed|called|calls|asked|asks|replied|told|gave|sent|signed|joined|mentioned|owns|speaking|schrieb|sagte|meldete? sich|wohnt|arbeitet|rief|bat|bittet|vive|"
    r"escribió|dijo|trabaja|llamó|pidió|habite|travaille|appelle|écrit|demande)\b| \([^)\n]*(?:@|[\[({]at[\])}])|\s*<\S+@|, (?:Flat|Apt|P\.O\.|\d|wohnhaft|domiciliad|demeurant|aged|born)|\", \"(?:e?mail|phone|tel)\"|;[A-Z][\w'’-]+;)"
)
RELEASE = re.compile(r"\A(?: [A-Z]\w+)? (?:release|roadmap|team|suite|server|project)\b")
STREET = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Drive|Dr|Boulevard|Blvd|Court|Ct|Place|Square|Way|Terrace|Close|Crescent|Row)"
# ---- end of fixed values --------------------------------------------------------------------

_DOT = r"(?:\s*(?:\[dot\]|\(dot\)|\{dot\})\s*|\.)"
_AT = r"(?:\s*(?:\[at\]|\(at\)|\{at\})\s*|\s?@\s?)"
AT_SIGN = re.compile(r"@|[\[({]at[\])}]", re.I)
_TOD = r"(?:\s*(?:\]tod\[|\)tod\(|\}tod\{)\s*|\.)"
#: The local part of an address, read backwards from its sign; and what follows the sign.
LOCAL_BACK = re.compile(rf"[\w%+\-]+(?:{_TOD}[\w%+\-]+)*", re.I)
DOMAIN = re.compile(rf"{_AT}[\w\-]+(?:{_DOT}[\w\-]+)*{_DOT}[^\W\d_]{{2,}}", re.I)
PHONE = re.compile(r"(?<![\w.\-/:#])\+?\(?\d[\d ()./\-]{5,20}\d(?:\s*(?:ext|x|Durchwahl)\.?\s*\d+)?(?![\w]|[.\-/:]\d)")
_NUMERAL = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|double|null|eins|zwei|drei|vier|fünf|sechs|sieben|acht|neun|cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|zéro|un|deux|trois|quatre|cinq|sept|huit|neuf)"
SPOKEN = re.compile(rf"\b{_NUMERAL}(?:[ ,\-]+{_NUMERAL}){{5,}}\b", re.I)
ID_NUMBER = re.compile(
    r"(?<![\w.\-/])(?:\d{3}[- ]\d{2}[- ]\d{4}|\d{2} \d{3} \d{3} \d{3}|\d{11}|[XYZ]?\d{7,8}-?[A-Z]|[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2}|[A-Z0-9]{9,10}|\d{6}[-+]\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]{1,2}\d{6,8})(?![\w]|[.\-/]\d)"
)
_CAP = r"[A-ZÀ-ÖØ-Þ][\wÀ-ÿ'’\-]+"
ADDRESS = re.compile(
    rf"(?:(?:Flat|Apt\.?|Unit|Suite) \w+, )?\d{{1,5}}[A-Za-z]?,? (?:{_CAP} ){{1,3}}{STREET}\b\.?(?:, (?:Apt|Flat|Unit|Suite)\.? \w+)?(?:, {_CAP}(?: [A-Z]{{1,2}}\d{{1,2}} ?\d[A-Z]{{2}}|, [A-Z]{{2}} \d{{5}})?)?"
    rf"|\d{{1,4}}(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|place|chemin|allée|impasse|quai)(?: (?:de la|de l'|des|du|de|d'))? ?{_CAP}(?:,\s*\d{{5}} {_CAP})?"
    rf"|\b(?:[Cc]alle|[Aa]venida|[Pp]laza|[Pp]aseo|[Vv]ia|[Vv]iale|[Pp]iazza|[Cc]orso|[Rr]ua|[Pp]raça)(?: (?:de la|del|de los|de|da|do|dei|della))? {_CAP},? \d{{1,4}}(?:,\s*\d{{5}} {_CAP})?"
    rf"|\b(?:{_CAP}(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring)|{_CAP}(?: |-)(?:Straße|Strasse|Str\.|Weg|Gasse|Platz|Allee)) \d{{1,4}} ?[a-z]?\b(?:,?\s+\d{{5}} {_CAP})?"
    rf"|\bP\.? ?O\.? Box \d+(?:, {_CAP})?|\b(?:Postfach|Apartado|Boîte postale|BP) \d+(?:,? \d{{5}})?(?: {_CAP})?"
)
STREET_SIGN = re.compile(rf"\b{STREET}\b|straße|strasse|str\. |weg \d|gasse \d|platz \d|allee \d|ufer \d|damm \d|ring \d|Straße|Platz|\b(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai)\b|[Cc]alle |venida |laza |aseo |[Vv]iale? |iazza |orso |[Rr]ua |raça |O\.? Box|Postfach|Apartado|postale|BP \d")
CITY = re.compile(rf"(?:\b\d{{5}} {_CAP}|[A-Z]{{1,2}}\d{{1,2}} \d[A-Z]{{2}}\b|\b[A-Z]{{2}} \d{{5}}\b|, {_CAP}\Z)")
ADDRESS_CUES = re.compile(
    r"(?:liv(?:es?|ed|ing) (?:at|in)|address is|offices? (?:is|at)|Anschrift:|address:|adresse\s*:|wohnt in|habite(?: au)?|vive en|(?:moved|send|sent|ship|shipped|deliver|delivered)(?: \w+){0,4} to|wohnhaft(?: in)?|domiciliad[oa] en|demeurant(?: au)?|;|,|:|\n|\"address\":\s*\")\s*\Z",
    re.I,
)
ADDRESS_AFTER = re.compile(r"\A(?:\.|;|\n|\"|,|\)|\Z)")
_UPPER = "".join(c for c in map(chr, range(0x1F000)) if c.isupper() or c.istitle())
_INNER = r"(?:[^\W\d_]|['’\u0300-\u036f])"
_NAME_START, _NAME_END = r"(?<![\w@.+/\\\-\[#$])", r"(?![\w'’\u0300-\u036f@+/\\\[(]|\.\w|-\w)"
NAME = re.compile(rf"{_NAME_START}[{_UPPER}]{_INNER}+(?:-[{_UPPER}]{_INNER}+)*{_NAME_END}")
#: Words of fewer letters are proposed only where a given name, a title or a cue stands beside them.
SHORT_NAME = 4
SAID = re.compile(r"\bthis is (?:[\w'’\-]+ ){1,2}(?:van |von |de )?(?P<n>[\w'’\-]{4,}) speaking", re.I)
_LOWER = re.compile(r"(?<![\w@.+/\-])[a-zà-öø-ÿß]{2,}(?![\w@+/]|-\w)")
_PAIR = re.compile(r"(?P<n>[^\W\d_]{2,}) (?:and|und|y|et|&) \Z")
BANK = re.compile(r"(?:\b[A-Z]{2}\d{2}(?: ?[\dA-Z]{4})* ?|\bIBAN\W{0,3}|\bBIC\W{0,3})\Z")
_PREV = re.compile(r"([\w'’.\-]+)(\W{0,3})\Z")
_NEXT = re.compile(r"\A(\W{0,3})([\w'’\-]+)")


@functools.lru_cache(maxsize=1 << 17)
def fold(word: str) -> str:
    """Lower case without marks, umlauts as in addresses."""
    if word.isascii():
        return word.lower()
    word = word.lower().replace("ö", "oe").replace("ü", "ue").replace("ä", "ae").replace("ß", "ss")
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def name_key(word: str) -> str:
    """Under what a family name is counted."""
    return fold(word.rpartition("-")[2])


def lexicon_vote(n: int, favoured: int) -> str:
    """What ``n`` proposals of a word, of which ``favoured`` have a given name or a title before them, say of each of them."""
    return "+" if favoured >= 2 and 5 * favoured >= n else "-" if n >= 8 and not favoured else "0"


def _shape(s: str) -> str:
    return re.sub(r"a+", "a", re.sub(r"[A-Z]", "A", re.sub(r"[a-z]{2,}", "a", re.sub(r"\d", "9", s))))[:24]


class Labelers:
    """Proposes spans of a text and lets the labelers vote on them."""

    def __init__(self, given: frozenset[str], common: frozenset[str]) -> None:
        self.given, self.common = given, common

    def spans(self, text: str) -> Iterator[tuple[str, int, int, str, list[str]]]:
        """(kind, start, end, votes, features); votes are ``+``, ``-`` or ``0`` per labeler."""
        mails = []
        back = ""
        for at in AT_SIGN.finditer(text):
            first = at.start()
            while first and text[first - 1].isspace() and at.start() - first < 3:
                first -= 1
            domain = DOMAIN.match(text, first) or DOMAIN.match(text, at.start())
            if not domain or mails and at.start() < mails[-1][1]:
                continue
            back = back or text[::-1]
            local = LOCAL_BACK.match(back, len(text) - domain.start())
            if not local:
                continue
            start = max(len(text) - local.end(), mails[-1][1] if mails else 0)
            if start < domain.start():
                mails.append((start, domain.end()))
                yield self.mail(text, start, domain.end(), text[start : domain.start()])
        taken = list(mails)
        for m in ADDRESS.finditer(text) if STREET_SIGN.search(text) else ():
            if not _within(m.start(), taken):
                taken.append(m.span())
                yield self.address(text, m)
        for m in ID_NUMBER.finditer(text):
            if any(c.isdigit() for c in m.group()) and not _within(m.start(), mails):
                found = self.identity(text, m)
                if found:
                    yield found
        for m in PHONE.finditer(text):
            digits = sum(c.isdigit() for c in m.group())
            if 7 <= digits <= 18 and not _within(m.start(), taken):
                yield self.phone(text, m)
        for m in SPOKEN.finditer(text):
            yield ("PHONE", m.start(), m.end(), "+" + ("+" if PHONE_CUES.search(text[max(0, m.start() - 24) : m.start()]) else "0") + "00", ["spoken"])
        local = " ".join(fold(text[a:b]) for a, b in mails)
        for m in NAME.finditer(text):
            word = m.group()
            short = len(word.partition("-")[0]) < SHORT_NAME
            found = None if short and word.lower() in TITLES or _within(m.start(), taken) else self.name(text, m.start(), m.end(), local)
            if found and (not short or "+" in found[3][:3]):
                yield found
        if "speaking" in text:
            for m in SAID.finditer(text):
                if m["n"].islower() and fold(m["n"]) not in self.given:
                    found = self.name(text, *m.span("n"), local)
                    if found:
                        yield found

    def mail(self, text: str, start: int, end: int, name: str):
        before, after = text[max(0, start - 24) : start], text[end : end + 3]
        service = name.lower() in SERVICE_LOCALS
        path = bool(re.match(r":[\w/~]", after))
        parts = [p for p in re.split(r"[._\-+\s\[\]()]+|dot", fold(name)) if p]
        person = any(p in self.given for p in parts) or any(len(p) >= 6 and p.isalpha() and p not in self.common for p in parts)
        votes = ("-" if service else "0") + ("-" if path else "0") + ("+" if EMAIL_CUES.search(before) else "0") + ("+" if person else "-")
        return "EMAIL", start, end, votes, [f"local={name.lower()}" if service else "local", f"at={'@' in text[start:end]}", f"path={path}"]

    def phone(self, text: str, m: re.Match):
        s = m.group()
        before, after = text[max(0, m.start() - 24) : m.start()], text[m.end() : m.end() + 16]
        digits = re.sub(r"\D", "", s)
        bad = bool(
            re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", s)
            or re.match(r"(?:19|20)\d\d[-./]\d\d", s)
            or re.fullmatch(r"\d{4}-\d{3}|\d{4}\.\d{4}\.\d{2}|\d{12,}|\d+\.\d+(?:\.\d+)?", s)
            or re.search(r"\d{2}:\d{2}\Z", s)
        )
        good = bool(
            re.match(r"\+\d|00\d{2}\D|\(?0\d{1,5}\)?[ /.\-]?\d", s) and 8 <= len(digits) <= 16
            or re.match(r"(?:1[ .\-])?\(?555\)?[ .\-]\d", s)
            or re.fullmatch(r"\(?\d{3}\)?[ .\-]\d{3}[ .\-]\d{4}", s)
        )
        identity = bool(ID_WORDS.search(text[max(0, m.start() - 44) : m.start()]) or BANK.search(before))
        bad = bad or identity
        cue = bool(PHONE_CUES.search(before) or PHONE_AFTER.match(after))
        against = bool(NOT_PERSONAL.search(before)) and not PHONE_CUES.search(before)
        votes = ("-" if bad else "+" if good else "0") + ("+" if cue else "0") + ("-" if against else "0") + ("-" if identity else "0")
        return "PHONE", m.start(), m.end(), votes, [f"shape={_shape(s)}", f"prev={_word_before(before)}"]

    def identity(self, text: str, m: re.Match):
        s = m.group()
        before, after = text[max(0, m.start() - 44) : m.start()], text[m.end() : m.end() + 16]
        cue = bool(ID_WORDS.search(before))
        if not cue and not re.search(r"(?:\bid|ID|number|no\.|Nr\.?)\W{0,2}\Z", before):
            return None
        number = sum(c.isdigit() for c in s)
        against = bool(NOT_PERSONAL.search(before)) and not cue
        ends = bool(re.match(r"(?:[.,;)\n]|\Z)", after))
        votes = ("+" if cue else "-") + ("+" if number >= 6 else "-") + ("-" if against else "0") + ("+" if ends else "0")
        return "ID_NUMBER", m.start(), m.end(), votes, [f"shape={_shape(s)}", f"prev={_word_before(before)}"]

    def address(self, text: str, m: re.Match):
        s = m.group()
        before, after = text[max(0, m.start() - 60) : m.start()], text[m.end() : m.end() + 20]
        city = bool(CITY.search(s)) or bool(re.match(rf",?\s*(?:\d{{5}} )?{_CAP}", after))
        cue = bool(ADDRESS_CUES.search(before))
        words = re.findall(r"[a-zA-ZÀ-ÿ]{4,}", s)
        rare = sum(w.lower() not in self.common for w in words)
        votes = ("+" if city else "0") + ("+" if cue else "0") + ("+" if ADDRESS_AFTER.match(after) else "0") + ("+" if rare else "-")
        return "ADDRESS", m.start(), m.end(), votes, [f"shape={_shape(s)[:8]}", f"prev={_word_before(before)}", f"city={city}"]

    def name(self, text: str, start: int, end: int, local: str):
        word = text[start:end]
        key = name_key(word)
        common = word.lower() in self.common
        if fold(word) in self.given or word.lower() in NOBODY:
            return None
        # what leads to the word: particles and initials, a given name, a title
        given = titled = False
        first, prev = start, ""
        for step in range(4):
            p = _PREV.search(text, max(0, first - 24), first)
            if not p or "\n" in p.group(2) or p.group(2) not in (" ", ". "):
                break
            token = p.group(1).rstrip(".")
            prev = prev or token
            low = token.lower()
            if ("." in p.group(2) or p.group(1).endswith(".")) and low not in TITLES and len(token) > 1:
                break
            if low in TITLES and text[max(0, p.start() - 2) : p.start()].rstrip()[-1:].isdigit():
                break  # a unit (ms, m)
            if low in TITLES:
                titled, first = True, p.start()
                break
            if fold(token) in self.given or fold(token) in WIDE_GIVEN and token[:1].isupper():
                given, first = True, p.start()
            elif low in PARTICLES or len(token) == 1 and token.isupper():
                first = p.start()
            elif (
                not given and not step and not common and token[:1].isupper() and low not in NOBODY and not NAME_BEFORE.search(text, max(0, first - 24), first)
                and (low not in self.common or NAME_BEFORE.search(text, max(0, p.start() - 24), p.start()))
            ):
                # a given name that isn't known; what is before it decides
                first = p.start()
            else:
                break
        after = text[end : end + 40]
        n = _NEXT.match(after)
        if n and n.group(1) in (", ", ";") and (fold(n.group(2)) in self.given or fold(n.group(2)) in WIDE_GIVEN):
            given = True
        if not given and fold(word) in WIDE_GIVEN:
            return None
        wide = key in WIDE_FAMILY
        pair = _PAIR.search(text, max(0, start - 40), start)
        wide = wide or bool(pair) and name_key(pair["n"]) in WIDE_FAMILY
        if common and not (given or titled):
            return None
        cue = bool(NAME_BEFORE.search(text, max(0, first - 24), first)) or bool(NAME_AFTER.match(after))
        follows = bool(n) and n.group(1) == " " and n.group(2)[:1].isupper() and not n.group(2).isupper() and not given
        mail = len(key) >= 5 and key in local
        opens = start == first and (start == 0 or text[start - 2 : start].strip() in ("", ".", "!", "?", ":", "-") and text[max(0, start - 2) : start] != "  ")
        votes = (
            ("+" if given else "0")
            + ("+" if titled else "0")
            + ("+" if cue else "0")
            + ("-" if common else "0")
            + ("-" if RELEASE.match(after) else "0")
            + ("-" if follows else "0")
            + ("+" if mail else "0")
            + ("+" if wide else "0")
            + "0"  # what the corpus says of the word, see ``lexicon_vote``
            + ("-" if not (given or titled or cue or mail or wide) else "0")
        )
        features = [f"e3={key[-3:]}", f"opens={opens}", f"prev={fold(prev)[:12]}", f"next={fold(n.group(2))[:12] if n else ''}", f"caps={word.isupper()}", f"hyphen={'-' in word}"]
        return "NAME", first if given or titled else start, end, votes, features


def _word_before(before: str) -> str:
    m = re.search(r"([A-Za-zÀ-ÿ]+)\W*\Z", before)
    return m.group(1).lower()[:12] if m else ""


def _within(at: int, spans: list[tuple[int, int]]) -> bool:
    return any(a <= at < b for a, b in spans)


def label_model(patterns: dict[str, int], rounds: int = EM_ROUNDS) -> dict[str, float]:
    """What each vote says of the true class, as log odds by labeler and vote (``r0+``), and the ``prior``; by EM over pattern counts.

    A labeler has a distribution of its three votes under either class. They
    start in favour of what the votes say, with pseudo-counts that keep a
    labeler which always abstains neutral.
    """
    rows = sorted(patterns)
    if not rows:
        return {}
    votes = np.array([["-0+".index(c) for c in r] for r in rows])
    # where all abstain there is nothing to learn from, but a posterior
    n = np.array([patterns[r] if set(r) != {"0"} else 0 for r in rows], float)
    lean = (votes == 2).sum(1) - 1.5 * (votes == 0).sum(1)
    post = 1 / (1 + np.exp(-1.5 * (lean - 0.5)))
    prior_votes = np.array([[1.0, 4.0, 0.25], [0.1, 4.0, 1.5]])
    said: dict[str, float] = {}
    for _ in range(rounds):
        prior = np.clip((n * post).sum() + 1, 1e-9, None) / (n.sum() + 2)
        odds = np.full(len(rows), math.log(prior / (1 - prior)))
        said = {"prior": float(odds[0])}
        for j in range(votes.shape[1]):
            by_class = []
            for y, p in ((0, 1 - post), (1, post)):
                held = np.bincount(votes[:, j], weights=n * p, minlength=3) + prior_votes[y] * max(1.0, 0.002 * n.sum())
                by_class.append(np.log(held / held.sum()))
            odds += (by_class[1] - by_class[0])[votes[:, j]]
            said |= {f"r{j}{c}": float(by_class[1][i] - by_class[0][i]) for i, c in enumerate("-0+")}
        new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return said


def log_odds(model: dict[str, float], votes: str) -> float:
    """What a vote pattern, seen before or not, says of the true class."""
    return model.get("prior", 0.0) + sum(model.get(f"r{j}{c}", 0.0) for j, c in enumerate(votes))


def reliabilities(patterns: dict[str, int], rounds: int = EM_ROUNDS) -> dict[str, float]:
    """Posterior of the true class for each vote pattern."""
    model = label_model(patterns, rounds)
    return {v: 1 / (1 + math.exp(-max(-40.0, min(40.0, log_odds(model, v))))) for v in patterns}


def _offset(model: dict[str, float], votes: str) -> float:
    """Where the classifier starts from: half of what the votes say, within bounds."""
    return 0.5 * max(-8.0, min(8.0, log_odds(model, votes)))


def _named(votes: str, features: list[str]) -> list[str]:
    """Features of a span: all votes but a name's last, which only says that no other labeler is in favour."""
    return ["bias", *(f"v{i}{c}" for i, c in enumerate(votes[:-1] if len(votes) > 4 else votes)), *features]


def train(spans: list[tuple[str, list[str]]], model: dict[str, float], steps: int = 300) -> dict[str, float]:
    """Weights of a logistic regression fitted to the label model's posteriors, with the model's own (see ``label_model``)."""
    # each span counts twice, once without its words: words that weren't seen in training must not decide
    twice = [*spans, *((votes, []) for votes, _ in spans)]
    counts = Counter(f for votes, features in twice for f in _named(votes, features))
    index = {f: i for i, f in enumerate(sorted(f for f, c in counts.items() if c >= 2 or f == "bias"))}
    rows, cols = [], []
    offset = np.array([_offset(model, v) for v, _ in twice])
    target = 1 / (1 + np.exp(-np.clip([log_odds(model, v) for v, _ in twice], -40, 40)))
    for i, (votes, features) in enumerate(twice):
        for f in _named(votes, features):
            if f in index:
                rows.append(i)
                cols.append(index[f])
    if not index:
        return {}
    rows_, cols_ = np.array(rows), np.array(cols)
    w, seen = np.zeros(len(index)), np.full(len(index), 1e-8)
    for _ in range(steps):
        z = offset + np.bincount(rows_, weights=w[cols_], minlength=len(twice))
        g = np.bincount(cols_, weights=(1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)[rows_], minlength=len(index)) + 0.3 * w
        seen += g * g
        w -= 0.5 * g / np.sqrt(seen)
    return model | {f: float(w[i]) for f, i in index.items()}


def score(weights: dict[str, float], votes: str, features: list[str]) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, _offset(weights, votes) + sum(weights.get(f, 0.0) for f in _named(votes, features))))))


def common_words(texts: DataFrame) -> DataFrame:
    """``word``, ``n`` of lower-case words, counted per batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter()
            for t in batch.column(0).to_pylist():
                if t:
                    counts.update(_LOWER.findall(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return texts.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def proposals(nodes: DataFrame, given_names: DataFrame) -> DataFrame:
    """All proposed spans with votes and features, written to the shared folder."""
    spark = nodes.sparkSession
    texts = nodes.where(F.col("node_type").isin(*TYPES) & F.col("text").isNotNull() & (F.col("text") != "")).select("id", "ord", "text")
    counted = staged(common_words(texts).where("n >= 3"), "lower-words")
    total = counted.agg(F.sum("n")).first()[0] or 0
    common = frozenset(r["word"] for r in counted.where(F.col("n") >= F.lit(total * COMMON_SHARE)).collect())
    # the project's own names: a fixed table, kept whole
    given = frozenset(fold(r[0]) for r in given_names.select("given_name").where("given_name is not null").distinct().toLocalIterator())
    known = spark.sparkContext.broadcast((given, common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labelers = Labelers(*known.value)
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for i, o, t in zip(*(c.to_pylist() for c in batch.columns)):
                for kind, a, b, votes, features in labelers.spans(t):
                    word = name_key(re.split(r"\s", t[a:b])[-1]) if kind == "NAME" else None
                    for column, v in zip(out, (i, o, kind, a, b, votes, features, word)):
                        column.append(v)
            types = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["id", "ord", "kind", "start", "end", "votes", "features", "word"])

    schema = "id string, ord bigint, kind string, start int, end int, votes string, features array<string>, word string"
    raw = staged(texts.mapInArrow(run, schema), "proposals")
    # a word that elsewhere stands behind given names and titles is a name here too
    favoured = F.col("votes").startswith("+") | (F.substring("votes", 2, 1) == "+")
    lexicon = raw.where("word is not null").groupBy("word").agg(F.count("*").alias("_n"), F.count(F.when(favoured, 1)).alias("_f"))
    said = lexicon.select("word", F.when((F.col("_f") >= 2) & (5 * F.col("_f") >= F.col("_n")), "+").when((F.col("_n") >= 8) & (F.col("_f") == 0), "-").alias("_vote")).where("_vote is not null")
    last = F.when(F.col("_vote") == "+", "0").otherwise(F.substring("votes", 10, 1))
    votes = F.when(F.col("_vote").isNull(), F.col("votes")).otherwise(F.concat(F.substring("votes", 1, 8), "_vote", last))
    return staged(raw.join(said, "word", "left").select("id", "ord", "kind", "start", "end", votes.alias("votes"), "features"), "voted")


def fit(spans: DataFrame) -> dict[str, dict[str, float]]:
    """Classifier weights by kind; at most 3^9 vote patterns and ``TRAIN_SPANS`` spans a kind reach the driver."""
    patterns: dict[str, dict[str, int]] = defaultdict(dict)
    for r in spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect():
        patterns[r["kind"]][r["votes"]] = r["n"]
    weights = {}
    for kind in KINDS:
        model = label_model(patterns[kind])
        # thinned by hash first: the top of every task's rows would reach the driver otherwise
        thin = max(1, sum(patterns[kind].values()) // (TRAIN_SPANS * 5 // 4))
        some = spans.where(F.col("kind") == kind).select("votes", "features", F.xxhash64("id", "start").alias("_h"), "id", "start")
        some = some.where(F.pmod("_h", F.lit(thin)) == 0).orderBy("_h", "id", "start").limit(TRAIN_SPANS)
        weights[kind] = train([(r["votes"], r["features"]) for r in some.select("votes", "features").collect()], model)
    return weights


def accepted(nodes: DataFrame, given_names: DataFrame) -> DataFrame:
    """``id``, ``ord``, ``kind``, ``start``, ``end`` of the spans the classifier accepts."""
    spans = proposals(nodes, given_names)
    model = nodes.sparkSession.sparkContext.broadcast(fit(spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.value
        for batch in batches:
            kinds, votes, features = (batch.column(i).to_pylist() for i in (2, 5, 6))
            good = pa.array([score(weights[k], v, f) > 0.5 for k, v, f in zip(kinds, votes, features)], pa.bool_())
            yield batch.select([0, 1, 2, 3, 4]).filter(good)

    return spans.mapInArrow(run, "id string, ord bigint, kind string, start int, end int")


def _latest(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("id").agg(F.max("ord").alias("ord"))


def found_kinds(nodes: DataFrame, given_names: DataFrame) -> DataFrame:
    """``node_id``, ``kind`` of the counting rows."""
    found = accepted(nodes, given_names).select("id", "ord", "kind").distinct()
    return found.join(_latest(nodes), ["id", "ord"], "left_semi").select(F.col("id").alias("node_id"), "kind").distinct()


def masked(nodes: DataFrame, given_names: DataFrame) -> DataFrame:
    """``node_id``, ``text`` with placeholders, ``replaced`` (how many) of every node of ``TYPES``."""
    spans = accepted(nodes, given_names).groupBy("id", "ord").agg(F.collect_list(F.struct("start", "end", "kind")).alias("spans"))
    kept = F.when(F.col("node_type").isin(*TYPES), F.col("text"))
    rows = latest_by(nodes.select("id", "ord", "node_type", kept.alias("text")), "id", "ord", F.col("ord").alias("ord"), "node_type", "text").where(F.col("node_type").isin(*TYPES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for t, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                done: list[tuple[int, int, str]] = []
                for s in sorted(found or [], key=lambda s: KINDS.index(s["kind"])):
                    if not any(a < s["end"] and s["start"] < b for a, b, _ in done):
                        done.append((s["start"], s["end"], s["kind"]))
                for a, b, kind in sorted(done, reverse=True):
                    t = f"{t[:a]}[{kind}]{t[b:]}"
                texts.append(t)
                counts.append(len(done))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["node_id", "text", "replaced"])

    return rows.join(spans, ["id", "ord"], "left").select("id", "text", "spans").mapInArrow(run, "node_id string, text string, replaced int")
