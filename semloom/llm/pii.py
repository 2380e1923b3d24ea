"""Personal information inside free text: overlapping candidates, boosted trees, calibrated thresholds.

Generators of high recall propose spans of each kind, several for one place
(with and without a town, one or more of a run of capitalised words). Every
candidate gets features of its format (groups, check digits, dates), of its
words (given names and surnames that are common somewhere), of its context
(labels and introductions in several languages and how far away they stand), and
how often its shape, its ending and the words around it belonged to such
information in the training texts. Of numbers a first stage turns down the shapes that were common
in the training texts and never right. Boosted trees per kind score all candidates of
a batch at once on arrays; a threshold per kind, chosen on held-out texts,
selects; of overlapping selected candidates the most probable stands. The model
file is made by ``semloom.llm.pii_train``.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semloom.session import col

KINDS = ("person_name", "email", "phone", "id_number", "street_address")
MODEL = Path(__file__).with_name("pii_model.json")



def _ranges(kinds: tuple[str, ...]) -> str:
    """A character class of all letters of these categories, for scripts that have capitals."""
    points = [i for i in range(0x250) if unicodedata.category(chr(i)) in kinds] + [i for i in (*range(0x370, 0x590), *range(0x1E00, 0x2000)) if unicodedata.category(chr(i)) in kinds]
    out, first = [], None
    for i, p in enumerate(points):
        first = p if first is None else first
        if i + 1 == len(points) or points[i + 1] != p + 1:
            out.append(re.escape(chr(first)) + (f"-{re.escape(chr(p))}" if p > first else ""))
            first = None
    return "".join(out)


_U, _L = _ranges(("Lu", "Lt")), _ranges(("Ll",)) + "\u0300-\u036f'’"
_S = r"[ \t\u00a0\u2009\u202f]{1,3}"
_WORD = rf"[{_U}](?:[{_L}]+(?:-[{_U}][{_L}]+)*|[{_U}'’]+(?:-[{_U}'’]+)*)(?![{_L}\w])"
#: Words that never are part of a name but stand before one in the same run of capitals. Fixed values.
_TITLE = r"(?:Dr|Prof|Mr|Mrs|Ms|Miss|Herr|Herrn|Frau|Mme|Mlle|Sr|Sra|Dra|Don|Doña|Sig|Pan|Pani|Pana|Panią|Doctor|Professor|Monsieur|Madame|Señor|Señora|DR|PROF|MR|MRS|MS|HERR|FRAU|MME|SR|SRA|κ|κα|Κος|Κα|Κυρία|Κύριος|δρ|Δρ|г-н|г-жа)"
_PARTICLES = ("van der", "van den", "von der", "de la", "de los", "dos", "de", "von", "van", "der", "den", "da", "del", "della", "di", "du", "le", "la", "zu", "ter", "af", "al", "el", "bin")
_PART = "(?:" + "|".join(w.replace(" ", r"[ \u00a0]") for p in _PARTICLES for w in (p, p.upper())) + ")"
#: A run of capitalised words, initials and particles, of any length.
RUN = re.compile(rf"[{_U}](?:\.|(?<=[{_U}])(?:[{_L}]+(?:-[{_U}][{_L}]+)*|[{_U}'’]+(?:-[{_U}'’]+)*)(?![{_L}\w]))\.?(?:,?{_S}(?:{_PART}{_S})?[{_U}](?:\.|[{_L}]+(?:-[{_U}][{_L}]+)*|[{_U}'’]+(?:-[{_U}'’]+)*)(?![{_L}\w]))+\.?")
RUN_PART = re.compile(rf"(?:{_PART}{_S})?(?:{_WORD}|[{_U}]\.?)")
NUMBER = re.compile(r"[+(\d][\d(](?:[\d().\-–‑/ \u00a0\u2009\u202f]{5,20}\d)(?!\w)")
#: Numbers that begin with a letter or two, or end with one.
CODE = re.compile(r"[\dA-Z](?<![^\W_][\dA-Z])(?:(?<=[A-Z])[A-Z]{0,2} ?\d|(?<=\d)[ -]?[\dA-Z])(?:[ -]?[\dA-Z]){4,18}(?!\w)|\d\d\.\d{3}\.\d{3}[-.]?[A-Z](?!\w)|\d\d[A-Z]{2}\d{5}(?!\w)")
_TOWN = rf"[{_U}](?:[{_L}]+(?:-[{_U}][{_L}]+)?|[{_U}]+)(?!\w)"
_BREAK = r"(?:,[ \t\u00a0\u2009\u202f]{0,3}(?:\r?\n|\r)?[ \t\u00a0\u2009\u202f]{0,3}|[ \t\u00a0\u2009\u202f]{0,3}(?:\r?\n|\r)[ \t\u00a0\u2009\u202f]{0,3})"
_KIND_OF_STREET = r"(?:[Ss]treet|STREET|St\b\.?|ST\b\.?|[Rr]oad|ROAD|Rd\b\.?|[Ll]ane|LANE|Ave(?:nue)?\b\.?|AVE(?:NUE)?\b\.?|[Cc]ourt|COURT|Drive|DRIVE|Dr\.|Close|Square|Terrace|Way|Crescent|Gardens|Boulevard|Blvd\b\.?|Place|Hill|Park|Row|Walk)(?!\w)"
_FLAT = rf"(?:(?:Flat|FLAT|Apt\.?|Unit){_S}\d+[A-Za-z]?,{_S})?"
_STREETS = (
    rf"{_FLAT}\d+[a-zA-Z]?{_S}(?:{_TOWN}{_S}){{1,3}}{_KIND_OF_STREET}",
    rf"\d+[a-zA-Z]?(?:{_S}(?:bis|ter|BIS|TER))?,?{_S}(?:rue|avenue|boulevard|place|quai|chemin|allée|impasse|RUE|AVENUE|BOULEVARD|PLACE|QUAI)(?:{_S}(?:de la|de l['’]|des|du|de|DE LA|DES|DU|DE))?{_S}?{_TOWN}(?:(?:{_S}|-){_TOWN}){{0,2}}",
    rf"(?:Calle|Avenida|Avda\.|Plaza|Paseo|Via|Viale|Piazza|Corso|Rua|CALLE|AVENIDA|PLAZA){_S}(?:(?:de la|del|de|della|di|da){_S})?{_TOWN}(?:{_S}{_TOWN})?,?{_S}\d+[a-zA-Z]?(?:,{_S}\d+\.[ºª°]{_S}[A-Z](?!\w))?",
    rf"(?:ul|al|os|pl|UL|AL)\.{_S}{_TOWN}(?:{_S}{_TOWN})?{_S}\d+[a-zA-Z]?(?:/\d+)?",
    rf"(?:Οδός|οδός|Λεωφόρος|Λεωφ\.|Οδ\.){_S}{_TOWN}(?:{_S}{_TOWN})?{_S}\d+[α-ωΑ-Ωa-zA-Z]?(?!\w)",
    rf"(?:{_TOWN}[- ])?(?:Straße|Strasse|Weg|Platz|Allee|Gasse){_S}\d+[a-zA-Z]?(?!\w)",
    rf"[{_U}](?:[{_L}]+(?:straße|strasse|str\.|gasse|weg|platz|allee|ring|damm|ufer)|[{_U}ß]+(?:STRASSE|STRAßE|STR\.|GASSE|WEG|PLATZ|ALLEE|RING)){_S}\d+[a-zA-Z]?(?!\w)",
)
#: How far before and after the word that every street has its pattern may reach: four words before and three after, each of up to forty letters.
BEFORE_HINT, AFTER_HINT = 200, 160
#: Where an address may begin: what a pattern needs is found first by a plain search.
STREET = re.compile(r"(?<![\w/.-])(?:" + "|".join(f"(?:{s})" for s in _STREETS) + ")")
#: Words one of which every street has; they are found first, as that is much faster than the patterns. Fixed values.
STREET_WORDS = (
    " St", " ST", " Road", " ROAD", " Rd", " Lane", " LANE", " Ave", " AVE", " Court", " COURT", " Drive", " DRIVE", " Close", " Square", " Terrace", " Way", " street", " road", " lane", " court",
    "rue ", "avenue ", "boulevard ", "place ", "quai ", "chemin ", "RUE ", "AVENUE ", "BOULEVARD ", "PLACE ", "QUAI ", "Calle ", "CALLE ", "Avenida ", "AVENIDA ", "Avda. ", "Plaza ", "PLAZA ", "Paseo ", "Via ", "Viale ", "Piazza ", "Corso ", "Rua ", "allée ", "impasse ", " Crescent", " Gardens", " Boulevard", " Blvd", " Place", " Hill", " Park", " Row", " Walk", " Dr.",
    "δός ", "Λεωφ", "Οδ. ", "Straße ", "Strasse ", "Weg ", "Platz ", "Allee ", "Gasse ", "damm ", "ufer ",
    "ul. ", "UL. ", "os. ", "OS. ", "al. ", "AL. ", "pl. ", "PL. ", "straße ", "strasse ", "str. ", "gasse ", "weg ", "platz ", "allee ", "ring ", "STRASSE ", "STRAßE ", "STR. ", "GASSE ", "WEG ", "PLATZ ", "ALLEE ", "RING ",
)
AFTER_STREET = (
    re.compile(rf"{_BREAK}(?:[A-Z]{{1,2}}-)?(?:\d{{5}}|\d\d-\d{{3}}|\d{{3}} \d\d|\d{{4}}(?: [A-Z]{{2}})?){_S}{_TOWN}(?:(?: am | an der |-|{_S}){_TOWN})?"),
    re.compile(rf"{_BREAK}(?:[A-Z]{{1,2}}-)?(?:\d{{5}}|\d\d-\d{{3}}|\d{{3}} \d\d|\d{{4}}(?: [A-Z]{{2}})?){_S}{_TOWN}"),
    re.compile(rf"{_BREAK}{_TOWN}(?:{_S}{_TOWN})?(?:{_S}|,{_S})[A-Z]{{1,2}}\d[A-Z\d]?{_S}\d[A-Z]{{2}}(?!\w)"),
    re.compile(rf"{_BREAK}{_TOWN}(?:{_S}{_TOWN})?,{_S}[A-Z]{{2}}{_S}\d{{5}}(?:-\d{{4}})?(?!\w)"),
    re.compile(rf"{_BREAK}{_TOWN}"),
)
_AT = ("@", "＠", "&#64;", "[at]", "(at)", " AT ", " at ", "(AT)", "[AT]", "{at}")
_LOCAL = re.compile(r"[A-Za-z0-9À-ž_](?:[A-Za-z0-9À-ž_.+%'-]{0,255})(?P<gap> ?)$")
_DOMAIN = re.compile(r" ?[A-Za-z0-9][A-Za-z0-9-]*(?:(?:\.| ?[(\[{](?:dot|DOT)[)\]}] ?| (?:DOT|dot) )[A-Za-z0-9-]+)*(?:\.| ?[(\[{](?:dot|DOT)[)\]}] ?| (?:DOT|dot) )[A-Za-z]{2,}(?![A-Za-z0-9-])")


def _emails(text: str) -> Iterator[tuple[int, int, str]]:
    for at in _AT:
        i = text.find(at)
        if i >= 0 and at in (" at ", " AT ") and " dot " not in text and " DOT " not in text:
            continue
        while i >= 0:
            right = _DOMAIN.match(text, i + len(at))
            if right and not (at.strip().isalpha() and not re.search(r"dot", right.group(), re.I)):
                left = _LOCAL.search(text, max(0, i - 258), i)
                if left and (at != "@" or not left["gap"] or text[i + 1 : i + 2] == " "):
                    yield left.start(), right.end(), "e" + at.strip()
            i = text.find(at, i + 1)


def _numbers(text: str) -> Iterator[tuple[int, int, str, str]]:
    for m in NUMBER.finditer(text):
        a, b = m.span()
        if a and (text[a - 1].isalnum() or text[a - 1] in "./-,_"):
            continue
        s = m.group()
        if not 7 <= sum(map(str.isdigit, s)) <= 16:
            continue
        while s.count("(") > s.count(")") and s[0] == "(":
            a, s = a + 1, s[1:]
        while s.count(")") > s.count("(") and s[-1] == ")":
            b, s = b - 1, s[:-1]
        yield a, b, "phone", s
    for m in CODE.finditer(text):
        a, b = m.span()
        if a and (text[a - 1].isalnum() or text[a - 1] in "./-,_+"):
            continue
        s = m.group()
        if sum(map(str.isdigit, s)) >= 6:
            yield a, b, "id_number", s
            # Letters before a blank may be the end of a label.
            if lead := re.match("[A-Z]+ ", s):
                yield a + lead.end(), b, "id_number", s[lead.end() :]


@lru_cache(1)
def _hints() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for w in STREET_WORDS:
        out.add_word(w, len(w))
    out.make_automaton()
    return out


def _addresses(text: str) -> Iterator[tuple[int, int, str]]:
    hints = sorted((k + 1 - n, k + 1) for k, n in _hints().iter(text.replace("\u00a0", " ")))
    seen = 0
    for h, k in hints:
        if h < seen:
            continue
        # A pattern begins at most some words before what gave the hint.
        for m in STREET.finditer(text, max(seen, h - BEFORE_HINT), min(len(text), k + AFTER_HINT)):
            a, b = m.span()
            if b <= h:
                continue
            if a > h:
                break
            seen = b
            yield a, b, "street"
            if text[b - 1] == ".":
                yield a, b - 1, "street"
            for form, p in zip(("long", "postal", "postal", "postal", "town"), AFTER_STREET):
                if t := p.match(text, b):
                    yield a, t.end(), form
                    seen = max(seen, t.end())
            break


def _names(text: str) -> Iterator[tuple[int, int, str]]:
    for run in RUN.finditer(text):
        parts = [(m.start(), m.end()) for m in RUN_PART.finditer(text, run.start(), run.end())]
        if parts and parts[0][0] and (text[parts[0][0] - 1].isalnum() or text[parts[0][0] - 1] in "/_@-#"):
            del parts[0]
        for i in range(len(parts)):
            form = ""
            for j in range(i, min(i + 5, len(parts))):
                a, b = parts[j]
                if j > i:
                    gap = text[parts[j - 1][1] : a]
                    if "," in gap:
                        form += ","
                    elif "." in gap and not form.endswith("I"):
                        break
                word = text[a:b]
                initial = len(word.rstrip(".")) == 1
                if initial and not word.endswith("."):
                    if b < len(text) and text[b] == ".":
                        b += 1
                    else:
                        break
                form += "I" if initial else "p" if word[0].islower() or word.split()[0].lower() in _PARTICLES else "W"
                if form in ("WW", "IW", "WIW", "WWW", "W,W", "W,I", "W,WI", "WI", "Wp", "Ip", "WIp", "p,W", "p,I", "p,WI", "pI", "WWI", "IIW", "IWW", "W,II", "WII", "WWWW", "WWp", "Wpp", "WIWW"):
                    yield parts[i][0], b, form
            title = text[max(0, parts[i][0] - 8) : parts[i][0]]
            if re.search(rf"(?<!\w){_TITLE}\.?[ \t\u00a0\u2009\u202f\n]{{1,3}}$", title):
                a, b = parts[i]
                if len(text[a:b].rstrip(".")) > 1:
                    yield a, b, "title"


_SINGLE_AFTER_TITLE = re.compile(rf"(?<!\w){_TITLE}\.?{_S}((?:{_PART}{_S})?(?!{_TITLE}(?!\w)){_WORD})")


def candidates(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, form) of all candidates of a text; they overlap."""
    out = [("email", a, b, f) for a, b, f in _emails(text)]
    out += [(kind, a, b, mask(s)) for a, b, kind, s in _numbers(text)]
    out += [("street_address", a, b, f) for a, b, f in _addresses(text)]
    out += [("person_name", a, b, f) for a, b, f in _names(text)]
    out += [("person_name", *m.span(1), "title") for m in _SINGLE_AFTER_TITLE.finditer(text)]
    return list(dict.fromkeys(out))


def mask(s: str) -> str:
    """The shape of a number or code."""
    return s.translate(_MASK)


_MASK = str.maketrans("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ‑\u00a0\u2009\u202f", "9" * 10 + "A" * 26 + "-   ")


_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|\n")


def _tokens(text: str) -> list[str]:
    return ["9" if t.isdigit() else "C" if t[0].isupper() and len(t) > 1 and t.lower() not in _CUES else t.lower() for t in _TOKEN.findall(text)]


#: Capitalised words that are kept as they are in a context. Fixed values, the words that stand at labels and titles in several languages.
_CUES = frozenset("dr prof mr mrs ms herr frau mme contact kontakt contacto tel phone call passport patient street road flat calle regards created according owner reviewed by author best thank ansprechpartner following personal documento identidad mail".split())


def right_words(text: str, b: int) -> tuple[str, str]:
    """The two words after a place, and the first of them."""
    words = _tokens(text[b : b + 24])[:2]
    return " ".join(words), words[0] if words else ""


def shape(text: str, kind: str, a: int, b: int, form: str) -> dict[str, str]:
    """What a candidate is looked up by of itself: its shape, the ending of its last word (of a name: its surname), its first word."""
    words = _LETTERS.findall(text[a:b])
    first, last = (words[0].lower(), words[-1].lower()) if words else ("", "")
    if kind == "person_name" and form in _SURNAME_FIRST:
        own = [w.lower() for w in words if w.lower() not in _PART_WORDS]
        first, last = (own[-1], own[0]) if own else (last, first)
    return {"form": form, "end": last[-4:] if kind == "street_address" else last[-3:], "first": first}


_LETTERS = re.compile(r"[^\W\d_]+")
_PART_WORDS = {w for p in _PARTICLES for w in p.split()}
_SURNAME_FIRST = frozenset(("W,W", "W,I", "W,WI", "p,W", "p,I", "p,WI", "W,II", "WI", "pI", "WII"))


def keys(text: str, kind: str, a: int, b: int, form: str) -> dict[str, str]:
    """``shape`` and the words around a candidate."""
    l1, l2, l3 = before(text, a)[0]
    r2, r1 = right_words(text, b)
    return shape(text, kind, a, b, form) | {"l1": l1, "l2": l2, "l3": l3, "r2": r2, "r1": r1}


#: Words that introduce a number of each sort, and those that introduce a person, in several languages, lower case.
PHONE_LABELS = "tel telephone telefon teléfono telefono téléphone tél phone call cell mobile mobil móvil handy fax rufnummer numer komórka τηλ τηλέφωνο κινητό телефон тел 电话 手机 هاتف ring reach whatsapp hotline dial"
ID_LABELS = "ssn social security passport passeport pasaporte reisepass paszport personal identity id ident nin nino dni nie nif pesel ausweis ausweisnummer personalausweis identité identidad documento documento tax steuer steuernummer steuer-id numéro sécu insee nss dowód dowodu αφμ αμκα ταυτότητα ταυτότητας διαβατήριο паспорт инн снилс 身份证 护照 هوية codice fiscale national licence license"
OTHER_LABELS = "cat catalogue lot batch charge ref reference strain stamm souche cepa szczep στέλεχος deposit method methode méthode método metoda protocol protokoll survey enquête encuesta order bestellung invoice rechnung isbn issn doi version build isolate sample probe próbka pr sop accession model account konto iban item article part sku serial grant project vol on am le el since dated date"
NAME_CUES = "contact kontakt contacto by von par por przez from dear author authors autor auteur autorin regards grüßen thank thanks dank patient respondent owner ask called named signed ansprechpartner ansprechpartnerin sincerely hallo hello hi lieber liebe sehr estimado cher chère według selon nach according with mit and und et y i sehr attn cc επικοινωνία υπεύθυνος ευχαριστούμε από контакт автор 联系人 联系 جهة reviewer editor manager supervisor director nurse doctor student colleague"
_LABEL = {w: k for k, words in ((0, OTHER_LABELS), (1, ID_LABELS), (2, PHONE_LABELS)) for w in words.split()}
_CUE = frozenset(NAME_CUES.split())
#: Given names and surnames that are common in some country, as a hint beside the context. Fixed values, lower case.
GIVEN = frozenset("""anna maria peter john paul hans thomas michael martin andreas stefan stephan klaus jürgen wolfgang karl heinz petra sabine monika claudia julia katharina lena lukas felix jonas emma mia james robert david william richard
 joseph charles daniel matthew mark steven andrew george mary patricia jennifer linda elizabeth susan jessica sarah karen nancy laura emily sophie jean pierre jacques philippe michel françois marie isabelle nathalie camille chloé luc antoine
 josé carlos juan luis miguel antonio javier manuel carmen ana lucía elena sofía isabel pablo diego jan piotr andrzej krzysztof tomasz marek paweł agnieszka małgorzata katarzyna magdalena ewa zofia giorgos γιώργος γιάννης νίκος κώστας δημήτρης μαρία ελένη
 κατερίνα αικατερίνη βασίλης giovanni marco luca giulia francesca alessandro erik lars anders ingrid astrid sven olga irina ivan dmitri sergei natalia александр иван мария ольга ahmed mohammed ali fatima omar yusuf wei li min yuki hiroshi raj priya amit
 kwame amara emre ruben nils tobias kenji malik ravi yara henrike""".split())
SURNAMES = frozenset("""müller schmidt schneider fischer weber meyer wagner becker schulz hoffmann koch bauer richter klein wolf schröder neumann braun krüger hofmann keller smith johnson williams brown jones miller davis wilson taylor anderson thomas
 moore martin jackson thompson white harris clark lewis robinson walker young allen king wright scott green baker hall roberts evans edwards hughes martin bernard dubois durand moreau laurent simon lefebvre leroy roux fournier garcía gonzález rodríguez fernández
 lópez martínez sánchez pérez gómez ruiz díaz torres nowak kowalski kowalska wiśniewski wójcik lewandowski zieliński kamiński rossi russo ferrari esposito bianchi romano jansen bakker visser hansen olsen larsen nilsson johansson andersson παπαδόπουλος παπαδοπούλου
 γεωργίου νικολάου οικονόμου ivanov petrov иванов петрова silva santos oliveira wang zhang chen liu kim lee park tanaka sato singh kumar patel khan hussein okafor mensah""".split())
#: Words that names of things are made of. Fixed values, lower case.
COMMON = frozenset("""street road survey model method protocol deposit strain table figure annex north south east west new great saint sea island river bay lake city state states county kingdom republic union european national international world federal
 institute university laboratory department ministry agency authority society foundation centre center company group university hospital school church market main high food safety risk assessment quality control data set dose response growth rate
 mean counts count total number heart brain infusion broth agar soy medium solution buffer juice apple orange peel salt sugar milk cheese butter bread rice wheat corn potato tomato water oil vinegar monday tuesday wednesday thursday friday saturday sunday
 january february march april june july august september october november december morning evening day week month year version part section chapter appendix square root equation function constant curve standard operating procedure good practice
 microsoft excel red blue green white black cross deutsche deutscher deutsches forschungsgemeinschaft bundesamt das der die ein eine modell probe proben einheit verfahren prüfverfahren stamm les des une modèle méthode souche el los las la le modelo método muestra cepa
 the this that these those and for with from according following data salmonella listeria escherichia bacillus vibrio campylobacter aspergillus clostridium staphylococcus""".split())
_NAME_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_DATE = re.compile(r"(?:19|20)\d\d([-./ ]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-./ ](?:0?[1-9]|1[0-2])[-./ ](?:19|20)?\d\d|(?:0?[1-9]|1[0-2])[-./ ](?:0?[1-9]|[12]\d|3[01])[-./ ](?:19|20)?\d\d")


def checks(s: str) -> float:
    """How many public rules of identity numbers a number or code keeps: check digits, or the ranges a number of its shape has to lie in."""
    plain = re.sub(r"[^0-9A-Z]", "", s)
    n = 0
    if len(plain) == 11 and plain.isdigit():
        n += (10 - sum(int(d) * w for d, w in zip(plain, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)))) % 10 == int(plain[10]) and 1 <= int(plain[2:4]) % 20 <= 12
    if re.fullmatch(r"[XYZ]?\d{7,8}[A-Z]", plain):
        number = plain[:-1].translate(str.maketrans("XYZ", "012"))
        n += "TRWAGMYFPDXBNJZSQVHLCKE"[int(number) % 23] == plain[-1]
    if re.fullmatch(r"\d{3}[- ]\d\d[- ]\d{4}", s):
        n += s[:3] not in ("000", "666") and s[4:6] != "00" and s[-4:] != "0000"
    if re.fullmatch(r"[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\d{6}[A-D]", plain):
        n += 1
    if re.fullmatch(r"[12]\d{2}(?:0[1-9]|1[0-2])\d{8}(?:\d\d)?", plain):
        n += 1
    return float(n)


#: Words before a place that are looked at, within so many characters.
WORDS_BEFORE, LETTERS_BEFORE = 8, 48


def before(text: str, a: int) -> tuple[tuple[str, str, str], list[int], int]:
    """What stands before a place: its last words, how many words ago the nearest label of each sort stands, and the nearest introduction of a person; 9 for none."""
    tokens = _TOKEN.findall(text[max(0, a - LETTERS_BEFORE) : a])[: -WORDS_BEFORE - 1 : -1]
    far, cue, words = [9, 9, 9], 9, []
    for i, t in enumerate(tokens):
        low = t.lower()
        k = _LABEL.get(low)
        if k is not None and far[k] == 9:
            far[k] = i
        if cue == 9 and low in _CUE:
            cue = i
        if i < 3:
            words.append("9" if t.isdigit() else "C" if t[0].isupper() and len(t) > 1 and low not in _CUES else low)
    if not words:
        return ("^", "", ""), far, cue
    l1, l2 = words[0], " ".join(words[1::-1])
    return (l1, l2, " ".join(words[::-1])), far, cue


def numbers(text: str, kind: str, a: int, b: int, left: tuple) -> list[float]:
    """What counts and dictionaries say of a candidate; ``left`` is ``before`` of its place."""
    s = text[a:b]
    out = [len(s), len(s.split()), sum(map(str.isdigit, s)), sum(map(str.isupper, s)) / max(1, len(s)), s.count("\n"), float(text[b : b + 1].islower())]
    if kind in ("phone", "id_number"):
        groups = re.findall(r"\d+", s)
        return out + [
            2.0 if s[0] == "+" else 1.5 if s[:2] == "00" else 1.0 if s[0] == "0" else 0.5 if s[0] == "(" else 0.0, len(groups), max(map(len, groups)), sum(map(str.isalpha, s)), 1.0 if s[-1].isalpha() else 0.0, *left[1], checks(s), float(_DATE.fullmatch(s) is not None),
        ]
    if kind == "person_name":
        words = [w.lower() for w in _NAME_WORD.findall(s) if len(w) > 1]
        given, sur = sum(w in GIVEN for w in words), sum(w in SURNAMES for w in words)
        return out + [given, sur, len(words) - given - sur, sum(w in COMMON for w in words), left[2], float(s.isupper()), float(text[b : b + 2].strip()[:1] in ("<", "(", "|", "@")), float(a == 0 or text[a - 1] == "\n"), float(text[b : b + 1] in ("", "\n", "\r", ".", ","))]
    if kind == "street_address":
        return out + [len(re.findall(r"\d+", s)), float(re.search(r"\d{4,5}|\d\d-\d{3}|[A-Z]\d[A-Z\d]? ?\d[A-Z]{2}", s) is not None), float(text[b : b + 1] in ("", "\n", "\r", ".", ",", ";", ")"))]
    return out


KEYS = ("form", "l1", "l2", "l3", "r2", "r1", "end", "first")


class Model:
    """Encodings of the keys, trees, calibration and threshold of each kind."""

    def __init__(self, path: str | Path):
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
        self.kinds = raw
        for m in raw.values():
            m["never"] = frozenset(m["never"])
            m["trees"] = [tuple(np.array(x) for x in t) for t in m["trees"]]

    def features(self, text: str, found: list[tuple[str, int, int, str]]) -> Iterator[tuple[str, int, int, list[float]]]:
        """(kind, start, end, row) of the candidates of a text, without those whose shape the first stage turns down; what stands around a place is read once for all candidates there."""
        stands: dict[int, tuple] = {}
        after: dict[int, tuple[str, str]] = {}
        for kind, a, b, form in found:
            own = self.kinds[kind]
            if form in own["never"]:
                continue
            if a not in stands:
                stands[a] = before(text, a)
            if b not in after:
                after[b] = right_words(text, b)
            left = stands[a]
            l1, l2, l3 = left[0]
            r2, r1 = after[b]
            k = shape(text, kind, a, b, form)
            rates, base = own["rates"], own["base"]
            yield kind, a, b, [
                rates["form"].get(form, base), rates["l1"].get(l1, base), rates["l2"].get(l2, base), rates["l3"].get(l3, base), rates["r2"].get(r2, base), rates["r1"].get(r1, base),
                rates["end"].get(k["end"], base), rates["first"].get(k["first"], base), *numbers(text, kind, a, b, left),
            ]

    def score(self, kind: str, rows: np.ndarray) -> np.ndarray:
        m = self.kinds[kind]
        margin = np.full(len(rows), m["start"])
        for tree in m["trees"]:
            margin += tree_values(tree, rows)
        return 1 / (1 + np.exp(-(m["slope"] * margin + m["shift"])))


def tree_values(tree: tuple, rows: np.ndarray) -> np.ndarray:
    """Values of the leaves of a full binary tree that rows fall in: (feature, cut) of inner nodes in level order, leaves' values."""
    feature, cut, value = tree
    at = np.zeros(len(rows), np.int64)
    inner = len(feature)
    span = np.arange(len(rows))
    while inner and at[0] < inner:
        at = 2 * at + 1 + (rows[span, feature[at]] > cut[at])
    return value[at - inner]


@lru_cache(2)
def model(path: str) -> Model:
    return Model(path)


def find(texts: list[str], m: Model) -> list[list[tuple[int, int, str]]]:
    """For each text the selected spans (start, end, kind) in order, none overlapping."""
    rows: dict[str, list[list[float]]] = {k: [] for k in KINDS}
    spans: dict[str, list[tuple[int, int, int]]] = {k: [] for k in KINDS}
    for i, text in enumerate(texts):
        for kind, a, b, row in m.features(text, candidates(text)):
            rows[kind].append(row)
            spans[kind].append((i, a, b))
    chosen: list[list[tuple[float, int, int, str]]] = [[] for _ in texts]
    for kind in KINDS:
        if rows[kind]:
            p = m.score(kind, np.array(rows[kind]))
            for (i, a, b), q in zip(spans[kind], p.tolist()):
                if q >= m.kinds[kind]["threshold"]:
                    chosen[i].append((q, a, b, kind))
    out = []
    for options in chosen:
        taken: list[tuple[int, int, str]] = []
        for _, a, b, kind in sorted(options, key=lambda x: (-round(x[0], 1), x[1] - x[2], x[1], x[3])):
            if all(b <= c or a >= d for c, d, _ in taken):
                taken.append((a, b, kind))
        out.append(sorted(taken))
    return out


def _rows(path: str, redact: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            found = find(texts, m)
            if redact:
                yield pd.DataFrame({"id": b["id"], "redacted": [None if not isinstance(t, str) else masked(t, f) for t, f in zip(b["text"], found)]})
            else:
                flat = [(i, k, x, y) for i, f in zip(b["id"], found) for x, y, k in f]
                yield pd.DataFrame(flat, columns=["id", "kind", "start_pos", "end_pos"])

    return run


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with ``[KIND]`` in place of each span and otherwise unchanged."""
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def find_personal(df: DataFrame, row_id: str, text: str, path: str = str(MODEL)) -> DataFrame:
    """(row_id, kind, start_pos, end_pos) of each place with personal information; positions count code points, the end is exclusive.

    Null, empty and blank texts have none; long texts are read whole; equal rows
    give equal places; other columns are ignored, so their names can't clash.
    Places of a row don't overlap. No shuffle; the model is a file that comes with the library.
    """
    out = df.select(col(row_id).cast("long").alias("id"), col(text).cast("string").alias("text")).mapInPandas(_rows(path, False), "id long, kind string, start_pos int, end_pos int")
    return out.withColumnRenamed("id", row_id)


def redact(df: DataFrame, row_id: str, text: str, path: str = str(MODEL)) -> DataFrame:
    """(row_id, redacted): the text with typed placeholders, otherwise unchanged; null stays null."""
    out = df.select(col(row_id).cast("long").alias("id"), col(text).cast("string").alias("text")).mapInPandas(_rows(path, True), "id long, redacted string")
    return out.select(F.col("id").alias(row_id), "redacted")
