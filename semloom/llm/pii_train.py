"""Trains the model of ``semloom.llm.pii`` on a bounded sample of texts: ``python -m semloom.llm.pii_train DOCUMENTS.parquet``.

The tables have no labels, so these are made in two ways. Sentences are made of
templates in several languages, with names, numbers and addresses of many forms
put in, so every span is known. In the corpus names are bootstrapped: given names
and surnames are gathered from sentences that introduce a person, whatever the
name looks like, and label all other places; numbers are labelled by what
introduces them and by formats, towns by being seen with a postal code. The trees
learn shape and context from both. As a new text holds words that were never seen,
what is looked up by a word is blanked in a part of the rows.

Texts whose checksum ends in ``HELD_OUT`` are never trained on; tests read those.
Encodings are counted on one half of the texts, trees are fitted on a quarter,
calibration and thresholds on the last quarter. ``SAMPLE`` bounds the texts.
"""

from __future__ import annotations

import json
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd

from semloom.llm.pii import _PARTICLES, GIVEN, ID_LABELS, KEYS, KINDS, MODEL, OTHER_LABELS, PHONE_LABELS, SURNAMES, before, candidates, keys, numbers, tree_values

SAMPLE, MADE = 20_000, 25_000
COMMON_SHAPE = 200  # from this many candidates on a shape without a right one is turned down
TREES, DEPTH, RATE = 90, 4, 0.25
LEAST = 4  # a value of a key is kept from this many candidates on
BETA = 1.5
BLANKED = 0.5  # of the rows, whose looked-up words are taken as unseen

PARTICLES = {w for p in _PARTICLES for w in p.split()}
PHONE = re.compile(
    r"\+1[- ]\d{3}[- ]\d{3}[- ]\d{4}|\(\d{3}\) \d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|\+49 \(0\) \d{2,3} / \d{6,8}|\+49 \d\d \d{5} \d{3}|\+49\.\d\d\.\d{5}\.\d{3}|0\d\d/\d{5}-\d{3}|0\d\d \d{5} \d{3}"
    r"|\+44 20 \d{4} \d{4}|\+44 \d{4} \d{3} \d{3}|0044 \(0\)\d{4} \d{6}|0\d{4} \d{6}|\(0\d{4}\) \d{3} \d{3}|\+33 \d(?: \d\d){4}|0033 \d{3}(?: \d\d){4}|0\d(?: \d\d){4}"
)
ID = re.compile(r"\d{3}-\d\d-\d{4}|\d{3} \d\d \d{4}|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-Z]|\d\d \d{3} \d{3} \d{3}|[A-Z]\d[A-Z]\d{5}[A-Z]|\d{6}-\d\d[A-Z]\d")
NOT_ID = re.compile(r"(?:cat|ref|lot|no|strain|Stamm|isbn)[.:]?\s*$", re.I)
OF_ID = re.compile(r"(?:security|personal|social|tax|id|ident\w*|pass\w*|pesel|nif|dni)\.?\s*(?:no|nr|id|n°|nº)?[.:]?\s*$", re.I)
NOT_PART = re.compile(r"(?:stammt|nombre|presencia|présence|croissance|Wachstum|strain|Proben?)\s+$")
_SENTENCE_NAME = r"\s*([^\W\d_]+(?:-[^\W\d_]+)*)[ \u00a0](?:[^\W\d_]\.[ \u00a0])?(?:(?:van der|van den|von|de|van|der|da|di|du|le|la)[ \u00a0])?([^\W\d_]+(?:-[^\W\d_]+)*)"
INTRODUCED = re.compile(r"(?:Created by|According to|Contact for this model:|Kontakt:|Contacto:|Ansprechpartner:|Best regards,|Grüßen|gate by|We thank|Farm owner:|author=\{|entregada por|effectué par|collected by|Patient|Επικοινωνία:|联系人:|dostarczył\(a\)|stammt von)" + _SENTENCE_NAME)
POSTAL_TOWN = re.compile(r"\d{5}[ \u00a0]([^\W\d_]+)|\d\d-\d{3}[ \u00a0]([^\W\d_]+)|([^\W\d_]+)[ \u00a0][A-Z]{1,2}\d{1,2}[ \u00a0]\d[A-Z]{2}\b")


def introduced_names(texts: list[str]) -> tuple[set[str], set[str]]:
    """Given names and surnames, lower case, of people whom a sentence introduces."""
    given, sur = Counter(), Counter()
    for t in texts:
        for m in INTRODUCED.finditer(t):
            if m[1][:1].isupper() and m[2][:1].isupper():
                given.update(x.lower() for x in m[1].split("-"))
                sur[m[2].lower()] += 1
    # A word that stands in both places is what it is more often.
    return {x for x, n in given.items() if n >= 3 and len(x) > 2 and n > sur[x]}, {x for x, n in sur.items() if len(x) > 2 and n > given[x]}


def towns(texts: list[str]) -> set[str]:
    seen = Counter(next(g for g in m.groups() if g).lower() for t in texts for m in POSTAL_TOWN.finditer(t))
    return {x for x, n in seen.items() if n >= 2}


def name_label(text: str, a: int, b: int, form: str, given: set[str], surnames: set[str]) -> bool:
    s = text[a:b]
    words = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*\.?", s)
    low = [w for w in words if w.rstrip(".").lower() not in PARTICLES]
    if len(low) < len(words) and words[0] != low[0] and NOT_PART.search(text[max(0, a - 16) : a]):
        return False
    known = lambda w: all(x in given for x in w.lower().rstrip(".").split("-"))
    sur = lambda w: (w.rstrip(".").lower() in surnames or all(x in surnames for x in w.rstrip(".").lower().split("-"))) and not known(w)
    initial = lambda w: len(w.rstrip(".")) == 1
    if form == "title":
        # Not where a given name or more of the surname follows.
        return len(low) == 1 and sur(low[0]) and not re.match(r"[- \u00a0]+[A-ZÀ-Ž]\.?(?:\s|$)", text[b : b + 4])
    if "," in s:
        left, right = (re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*\.?", x) for x in s.split(",", 1))
        left = [w for w in left if w in low]
        return len(left) == 1 and sur(left[0]) and bool(right) and all(initial(w) or known(w) for w in right)
    if len(low) >= 2 and sur(low[-1]) and all(initial(w) or known(w) for w in low[:-1]):
        return True
    return len(low) == 2 and sur(low[0]) and initial(low[1]) and form in ("WI", "pI")


def labels(text: str, found: list[tuple[str, int, int, str]], given: set[str], surnames: set[str], known_towns: set[str]) -> list[bool]:
    """Which candidates of a text of the corpus are right."""
    out = []
    for kind, a, b, form in found:
        s = text[a:b].replace("‑", "-").replace("\u00a0", " ").replace("\u202f", " ").replace("\u2009", " ")
        before = text[max(0, a - 14) : a]
        if kind == "email":
            ok = True
        elif kind == "phone":
            ok = bool(PHONE.fullmatch(s)) and not NOT_ID.search(before.replace("Tel.", "").replace("tel.", ""))
        elif kind == "id_number":
            ok = bool(ID.fullmatch(s)) and (not NOT_ID.search(before) or bool(OF_ID.search(before)))
        elif kind == "street_address":
            town = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", s)
            ok = form == "street" and not (s[-1] != "." and text[b : b + 1] == "." and re.search(r"(?i) (?:st|ave|rd)$", s) is not None) or form == "postal" or form == "town" and town[-1].lower() in known_towns
        else:
            ok = name_label(text, a, b, form, given, surnames)
        out.append(ok)
    # Of nested right spans of one kind the longest is the right one.
    for i, (kind, a, b, _) in enumerate(found):
        if out[i] and any(out[j] and k == kind and (c, d) != (a, b) and c <= a and b <= d for j, (k, c, d, _) in enumerate(found)):
            out[i] = False
    return out


#: Sentences with places to fill, in several languages; {n} is a person, {s} a surname, {p} a phone, {i} an identity number with {I} its label, {a} an address, {e} an e-mail,
#: {t} a place, {m} a method or company, {o} an organism, {c} a code of another sort, {d} a date.
TEMPLATES = (
    "Please contact {n} ({e}) or call {p} for details.", "Contact: {n}, {p}", "{n} and {n} measured the growth of {o} in {t}.", "The study was led by {n} of the {m} in {t}.", "Dear Dr {s},\nthank you for the data of {d}.", "Kind regards,\n{n}\n{a}\n{p}",
    "The sample was handed in by {n}, who lives at {a}.", "{n}'s passport ({I} {i}) was checked on {d}.", "{I}: {i}", "{n}, {I} {i}, was interviewed.", "Her {I} is {i} and her phone number is {p}.", "We followed the {m} method; see lot {c} and order no. {c}.", "Strain {c} of {o} was isolated in {t} on {d}.",
    "Send the form to {a}, or by mail to {e}.", "Ms {s} asked for a copy, Mr {s} declined.", "Prof. {n} reviewed protocol {c}.", "{t} and {t} were compared by {m}.", "Data of {d} were fitted by the {m} model with batch {c}.", "Table Two shows Mean Counts of {o}.", "I met {n} in {t}; {n} had left.", "Authors: {n}, {n} and {n}.", "Signed: {n}", "According to {n}, {o} grew faster.", "Samples came from {a} on {d}.", "Participant {n} ({p}) moved to {a}.",
    "Kontakt: {n}, Tel. {p}, {e}", "Herr {s} wohnt in der {a}.", "Frau Dr. {s} hat die Proben aus {t} untersucht.", "Mit freundlichen Grüßen\n{n}\n{p}", "{n} ({I} {i}) wurde am {d} befragt.", "Die Probe {c} wurde nach dem {m} Verfahren geprüft.", "Ansprechpartnerin ist {n}, erreichbar unter {p}.", "Sehr geehrte Frau {s}, die Charge {c} liegt vor.", "Im Labor {m} in {t} wurde {o} gefunden.",
    "Contact : {n}, tél. {p}", "Mme {s} habite au {a}.", "M. {n} a remis l'échantillon {c} le {d}.", "Selon {n}, la souche {c} vient de {t}.", "Numéro : {I} {i}", "Cordialement,\n{n}\n{a}", "La méthode {m} fut appliquée à {o}.",
    "La Sra. {s} vive en {a}.", "Contacto: {n}, tel. {p}, {e}", "El paciente {n}, con {I} {i}, llegó el {d}.", "Según {n}, el lote {c} procede de {t}.", "Atentamente,\n{n}", "El modelo {m} describe {o}.",
    "Pan {s} mieszka przy {a}.", "Kontakt: {n}, tel. {p}", "{n} ({I} {i}) dostarczyła próbkę {c} dnia {d}.", "Z poważaniem,\n{n}\n{a}", "Επικοινωνία: {n}, τηλ. {p}", "Ο {n} μένει στην {a}.", "Η {n} ({I} {i}) έστειλε το δείγμα {c}.", "Ευχαριστούμε τον {n} για τα δεδομένα.", "联系人:{n},电话 {p},邮箱 {e}", "Contatto: {n}, tel. {p}\n{a}", "Контакт: {n}, тел. {p}",
    # Nothing but words around: {w} is any word, {P}, {Q}, {O} a label of a phone, an identity number, a number of another sort.
    "{n} {w} {w} {w}.", "{w} {w} {n} {w}.", "{W} {w} {n}, {w} {w}.", "{W} {w} {n}", "{n}, {w} {w} {w}.", "{W} {w} {w} {n} {w} {w} {d}.", "{n} <{e}> {w}:", "{w}: {n}; {n}", "{W} {w} {T} {s} {w} {w}.", "{T} {s} {w} {w} {w}.", "{T} {s},", "{W} {T} {n} {w}.", "{T} {n} {w} {w}.", "{n} {P} {p}",
    "{W} {w} {m} {w} {w}.", "{m} {w} {w} {o}.", "{W} {w} {t} {w}.", "{t} {w} {w}.", "{W} {m} {w} {m} {w} {d}.", "{o} {w} {w} {w}.",
    "{P} {p} {w} {w}.", "{P}: {p}", "{W} {w} {P} {p}, {w}.", "{W} {w} {p} {w}.", "{w} {P} {w} {p}.", "{Q} {i} {w} {w}.", "{Q}: {i}", "{I} {i}, {w} {w}", "{W} {w} {Q} {w} {i}.", "{W} {I}, {i}, {w} {w}.", "{W} {w} {I} {i} {w} {w}.", "{O} {c} {w} {w}.", "{W} {w} {O} {c}.", "{W} {O} {w} {c} {w} {d}.", "{O}. {w}. {c} {w}.", "{w} {c} {w} {w}",
    "{W} {w} {w} {a}, {w} {w}.", "{a} {w} {w} {w}.", "{W} {w} {a} {w}.", "{W}: {a}", "{W} {w} {w} {a}.",
)
PLACES = "New York;San Francisco;United Kingdom;Great Britain;North Sea;Rio Grande;Bad Homburg;Nowy Sącz;Buenos Aires;Den Haag;South Africa;Baden Württemberg;Costa Rica;East Anglia;Novi Sad;Hong Kong;Nea Makri;Central Europe"
METHODS = "Monte Carlo;Baranyi Roberts;Michaelis Menten;Kolmogorov Smirnov;Brain Heart;Ringer Solution;Risk Assessment;Food Safety;Quality Control;Max Rubner;Louis Pasteur;World Health;Microsoft Excel;Heart Infusion Broth;Good Laboratory Practice;Standard Operating Procedure;Quantitative Microbial Risk Assessment;Gauss Newton;Red Cross;Data Set;Baker Street Survey;Dose Response"
ORGANISMS = "Listeria monocytogenes;Salmonella Enteritidis;Escherichia Coli;Campylobacter Jejuni;Bacillus Cereus;Vibrio Cholerae;Salmonella Typhimurium;Clostridium Botulinum;Aspergillus Flavus"
TOWNS = "London;Leeds;York;Bristol;Oxford;Berlin;München;Hamburg;Köln;Leipzig;Paris;Lyon;Lille;Nantes;Madrid;Sevilla;Valencia;Bilbao;Warszawa;Kraków;Gdańsk;Wrocław;Roma;Milano;Torino;Wien;Graz;Zürich;Bern;Athen;Springfield;Portland;Austin;Boston"
STREET_NAMES = "Park;High;Church;Station;Mill;Victoria;Queen;King;Oak;Maple;Elm;Rose;Garden;Bridge;School;Linden;Berg;Bahnhof;Schiller;Goethe;Kirch;Mozart;Garten;Verdi;Rivoli;Pasteur;Hugo;Mayor;Alcalá;Cervantes;Długa;Polna;Leśna;Szkolna;Kwiatowa;Garibaldi;Dante;Mazzini"
TITLES = ("Dr", "Dr.", "Prof.", "Prof. Dr.", "Mr", "Mr.", "Mrs", "Mrs.", "Ms", "Ms.", "Miss", "Herr", "Frau", "Herr Dr.", "Herrn", "Mme", "Madame", "Monsieur", "Sr.", "Sra.", "Señora", "Señor", "Pan", "Pani", "Κυρία", "Κα", "Doctor", "Professor")
WORDS = """was is has had keeps lives wrote said called went came left showed gave took signed owns likes runs leads asked answered moved found the a an of to in on at for with by from and or but not when where who which about after before between during under over
 sample samples cheese milk soup freezer garage paper report letter archive key bench lamp garden barn church town village spring summer today yesterday tomorrow twice often never soon again still only also very quite new old small large late early red ist war hat wohnt
 schrieb sagte kam ging leitet und oder nicht mit nach bei vor unter über die der das ein eine est a été habite garde avec pour dans chez mais pas le la les un une es fue tiene vive envió con para en por pero el los jest ma mieszka oddała przyszedł i w na z do był έστειλε
 μένει απάντησε στο στην και είναι με από τα wants reads checks weighs stirs tested grew fitted compared stored cooled heated mixed counted plated frozen thawed""".split()
ID_WORDS = {"en": ("SSN", "social security no.", "passport no.", "ID card", "tax ID", "national insurance number", "NINO", "Passport"), "de": ("Personalausweis", "Ausweisnummer", "Steuer-ID", "Reisepass"), "fr": ("numéro de sécu", "passeport n°", "pièce d'identité n°"), "es": ("DNI", "NIE", "NIF", "pasaporte"), "pl": ("PESEL", "dowód", "paszport"), "el": ("ΑΦΜ", "ΑΜΚΑ", "διαβατήριο")}


class Maker:
    """Sentences of ``TEMPLATES`` with their spans."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.given, self.sur = sorted(GIVEN), sorted(SURNAMES)

    def digits(self, shape: str) -> str:
        return "".join(self.r.choice("0123456789") if c == "9" else self.r.choice("ABCDEFGHJKLMNPRSTWXYZ") if c == "A" else c for c in shape)

    def invented(self) -> str:
        return "".join(self.r.choice(("ba", "ke", "lor", "min", "tas", "vel", "dro", "pi", "gan", "shu", "rem", "ol", "fin", "ste", "cha", "wu")) for _ in range(self.r.randint(2, 3))).title()

    def word(self, known: list[str]) -> str:
        return self.r.choice(known).title() if self.r.random() < 0.45 else self.invented()

    def surname(self) -> str:
        own = self.word(self.sur)
        return own + "-" + self.word(self.sur) if self.r.random() < 0.06 else self.r.choice(("von ", "de ", "van der ")) + own if self.r.random() < 0.06 else own

    def name(self) -> str:
        given, own = self.word(self.given), self.surname()
        made = self.r.choices((f"{given} {own}", f"{own}, {given}", f"{given[0]}. {own}", f"{own} {given[0]}.", f"{given} {self.r.choice('ABEHJKLM')}. {own}", f"{given} {own} {self.surname()}", f"{own}, {given[0]}.", f"{given}-{self.word(self.given)} {own}"), (60, 8, 8, 4, 6, 6, 4, 4))[0]
        return made.upper() if self.r.random() < 0.03 else made

    def label(self, words: str) -> str:
        own = self.r.choice(words.split())
        return own.title() if self.r.random() < 0.4 else own.upper() if len(own) < 5 and self.r.random() < 0.5 else own

    def phone(self) -> str:
        return self.digits(self.r.choice((
            "+1-999-999-9999", "+1 (999) 999-9999", "(999) 999-9999", "999-999-9999", "+49 99 99999 999", "+49 999 9999999", "099/99999-999", "0999 9999999", "+44 20 9999 9999", "+44 9999 999 999", "09999 999999", "+33 9 99 99 99 99", "09 99 99 99 99", "+34 999 999 999", "999 999 999",
            "+48 999 999 999", "99 999 99 99", "+30 999 999 9999", "210 999 9999", "+39 06 999 9999", "+7 (999) 999-99-99", "0049 999 99999999", "+43 9 9999999", "+86 139 9999 9999", "139 9999 9999", "+41 99 999 99 99", "+31 6 99999999", "0999-999999", "999.999.9999")))

    def identity(self) -> tuple[str, str]:
        lang = self.r.choice(sorted(ID_WORDS))
        label = self.r.choice(ID_WORDS[lang])
        shapes = {"SSN": ("999-99-9999",), "DNI": ("99999999A", "99999999-A", "99.999.999-A"), "NIF": ("99999999A",), "NIE": ("X9999999A", "Y9999999A"), "PESEL": ("99999999999",), "NINO": ("AA 99 99 99 A", "AA999999A"), "Steuer-ID": ("99 999 999 999", "99999999999"), "ΑΦΜ": ("999999999",), "ΑΜΚΑ": ("99999999999",), "numéro de sécu": ("2 99 99 99 999 999 99", "1999999999999"), "dowód": ("AAA 999999", "AAA999999"), "Personalausweis": ("A99A99A99", "A9AA99A99", "999999999"), "Ausweisnummer": ("A99A99A99", "999999999"), "passeport n°": ("99AA99999",), "tax ID": ("999-99-9999", "99-9999999")}
        return label, self.digits(self.r.choice(shapes.get(label, ("A99999999", "AA 999999", "AA9999999", "999999999", "A9AA99999", "AAA 999999", "99AA99999", "999 99 9999"))))

    def address(self) -> str:
        number, street, town = self.r.choice(("9", "99", "199")), self.r.choice(STREET_NAMES.split(";")) if self.r.random() < 0.7 else self.invented(), self.r.choice((TOWNS + ";Frankfurt am Main;Bad Homburg;San Sebastián;New York;Las Palmas;Newcastle").split(";")) if self.r.random() < 0.75 else self.invented()
        number = self.digits(number).lstrip("0") or "7"
        made = self.r.choice((
            f"{number} {street} {self.r.choice(('Street', 'Road', 'Lane', 'Avenue', 'Drive', 'Court', 'Close', 'Way', 'Square'))}", f"Flat {number}, {number} {street} Road", f"{number} {street} {self.invented()} Street", f"{street}{self.r.choice(('straße', 'str.', 'weg', 'gasse', 'allee', 'platz', 'ring'))} {number}{self.r.choice(('', '', 'a'))}",
            f"{number}, rue {street}", f"{number} rue de la {street}", f"{number} avenue {street}", f"Calle {street} {number}", f"Calle de {street}, {number}", f"Avenida {street} {number}", f"ul. {street} {number}/{number}", f"ul. {street} {number}", f"Via {street} {number}", f"{street} Allee {number}", f"Οδός Ερμού {number}"))
        brk = self.r.choice((", ", ", ", "\n"))
        post = self.r.choice(("99999 {}", "99-999 {}", "{} AA9 9AA", "{} AA99 9AA", "{} A9A 9AA", "{}, AA 99999", "999 99 {}", "9999 {}"))
        return made + (brk + self.digits(post).format(town) if self.r.random() < 0.6 else brk + town if self.r.random() < 0.25 else "")

    def email(self) -> str:
        return f"{self.invented().lower()}{self.r.choice(('.', '_', ''))}{self.invented().lower()}{self.r.choice(('@', '@', ' [at] ', '(at)'))}{self.invented().lower()}{self.r.choice(('.org', '.de', '.co.uk', '.example'))}"

    def code(self) -> str:
        return self.digits(self.r.choice(("999-99-9999", "9999 999 999", "AA-9999-99", "99-9999-A", "AAA-999-9999", "A99999999", "999/9999", "99999999", "AA9999999", "999999-99A9", "9999-9999", "999.999.9999", "99 999 999 999")))

    def date(self) -> str:
        y, m, d = self.r.randint(1990, 2025), self.r.randint(1, 12), self.r.randint(1, 28)
        return self.r.choice((f"{y}-{m:02}-{d:02}", f"{d}/{m}/{y}", f"{d:02}.{m:02}.{y}", f"{y}{m:02}{d:02}", f"{m:02}/{d:02}/{y}"))

    def sentence(self) -> tuple[str, list[tuple[str, int, int]]]:
        out, spans = "", []
        label, ident = self.identity()
        for part in re.split(r"(\{\w\})", self.r.choice(TEMPLATES)):
            kind = {"{n}": "person_name", "{s}": "person_name", "{p}": "phone", "{i}": "id_number", "{a}": "street_address", "{e}": "email"}.get(part)
            text = {"{n}": self.name, "{s}": self.surname, "{p}": self.phone, "{i}": lambda: ident, "{I}": lambda: label, "{a}": self.address, "{e}": self.email, "{t}": lambda: self.r.choice(PLACES.split(";")), "{m}": lambda: self.r.choice(METHODS.split(";")), "{o}": lambda: self.r.choice(ORGANISMS.split(";")), "{c}": self.code, "{d}": self.date, "{w}": lambda: self.r.choice(WORDS), "{W}": lambda: self.r.choice(WORDS).title(), "{T}": lambda: self.r.choice(TITLES), "{P}": lambda: self.label(PHONE_LABELS), "{Q}": lambda: self.label(ID_LABELS), "{O}": lambda: self.label(OTHER_LABELS)}.get(part, lambda part=part: part)()
            if kind:
                spans.append((kind, len(out), len(out) + len(text)))
            out += text
        return out, spans

    def text(self) -> tuple[str, list[tuple[str, int, int]]]:
        out, spans = "", []
        for _ in range(self.r.randint(1, 4)):
            s, own = self.sentence()
            spans += [(k, a + len(out), b + len(out)) for k, a, b in own]
            out += s + self.r.choice((" ", "\n", "\n\n"))
        return out, spans


def held_out(text: str) -> bool:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % 10 == 0


def fit_trees(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Boosted full trees on logistic loss, cuts at quantiles."""
    base = min(max(y.mean(), 1e-3), 1 - 1e-3)
    start = float(np.log(base / (1 - base)))
    margin = np.full(len(y), start)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 40))) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p) + 1e-6
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.zeros(2**DEPTH - 1)
        for level in range(DEPTH):
            first = 2**level - 1
            gain, pick = np.full(2**level, 1e-9), [(0, np.inf)] * 2**level
            local = node - first
            for j, c in enumerate(cuts):
                width = len(c) + 1
                at = local * width + binned[:, j]
                gs = np.bincount(at, g, 2**level * width).reshape(-1, width).cumsum(1)
                hs = np.bincount(at, h, 2**level * width).reshape(-1, width).cumsum(1)
                total_g, total_h = gs[:, -1:], hs[:, -1:]
                score = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                score = score[:, : len(c)]
                if not len(c):
                    continue
                best = score.argmax(1)
                for k in range(2**level):
                    if score[k, best[k]] > gain[k]:
                        gain[k], pick[k] = score[k, best[k]], (j, c[best[k]])
            for k, (j, c) in enumerate(pick):
                feature[first + k], cut[first + k] = j, c
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        leaf = node - (2**DEPTH - 1)
        value = -RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        margin += value[leaf]
        trees.append((feature, cut, value))
    return start, trees


def train(texts: list[str]) -> dict:
    (given, surnames), known = introduced_names(texts), towns(texts)
    print(f"{len(texts)} texts, {len(given)} given names, {len(surnames)} surnames, {len(known)} towns", file=sys.stderr)
    rows: dict[str, list[tuple[int, bool, dict[str, str], list[float], bool]]] = defaultdict(list)

    def add(i: int, text: str, found: list, right: list[bool], made: bool) -> None:
        for (kind, a, b, form), y in zip(found, right):
            rows[kind].append((i % 4, y, keys(text, kind, a, b, form), numbers(text, kind, a, b, before(text, a)), made))

    for i, text in enumerate(texts):
        found = candidates(text)
        add(i, text, found, labels(text, found, given, surnames, known), False)
    maker = Maker(11)
    for i in range(MADE):
        text, spans = maker.text()
        found = candidates(text)
        add(i, text, found, [(k, a, b) in spans for k, a, b, _ in found], True)
    blank = random.Random(5)
    out = {}
    for kind in KINDS:
        data = rows[kind]
        count: dict[str, Counter] = {n: Counter() for n in KEYS}
        hits: dict[str, Counter] = {n: Counter() for n in KEYS}
        for part, y, k, *_ in data:
            if part < 2:
                for n in KEYS:
                    count[n][k[n]] += 1
                    hits[n][k[n]] += y
        half = [y for part, y, *_ in data if part < 2]
        base = sum(half) / max(1, len(half))
        rates = {n: {v: round((hits[n][v] + base) / (c + 1), 4) for v, c in count[n].items() if c >= LEAST} for n in KEYS}
        # The first stage: shapes of numbers that are common and were never right, on the half the encodings are counted on.
        never = sorted(v for v, c in count["form"].items() if c >= COMMON_SHAPE and not hits["form"][v]) if kind in ("phone", "id_number") else []
        lost = sum(y for part, y, k, *_ in data if part >= 2 and k["form"] in never)
        print(f"  {kind}: {len(never)} shapes turned down, of {sum(y for part, y, *_ in data if part >= 2)} held-out right ones {lost}", file=sys.stderr)
        data = [r for r in data if r[2]["form"] not in set(never)]
        # In some rows the looked-up words count as unseen, in some all that stands around too.
        for row in data:
            if row[0] == 2 and blank.random() < BLANKED:
                row[2].update(dict.fromkeys(("end", "first", "form") if blank.random() < 0.6 else ("end", "first", "form", "l1", "l2", "l3", "r1", "r2"), ""))

        def table(wanted: int):
            x = np.array([[rates[n].get(k[n], base) for n in KEYS] + num for part, _, k, num, _ in data if part == wanted])
            return x, np.array([float(y) for part, y, *_ in data if part == wanted])

        (x, y), (xv, yv) = table(2), table(3)
        from_made = np.array([made for part, *_, made in data if part == 3])
        start, trees = fit_trees(x, y)
        margin = start + sum(tree_values(t, xv) for t in trees)
        slope, shift = 1.0, 0.0
        for _ in range(200):  # Platt's calibration by Newton steps that are cut short
            p = 1 / (1 + np.exp(-(slope * margin + shift)))
            g = np.array([((p - yv) * margin).mean() + 1e-3 * (slope - 1), (p - yv).mean()])
            w = p * (1 - p) + 1e-6
            hess = np.array([[(w * margin**2).mean() + 1e-3, (w * margin).mean()], [(w * margin).mean(), w.mean()]])
            step = np.linalg.solve(hess + 1e-6 * np.eye(2), g)
            slope, shift = slope - 0.5 * step[0], shift - 0.5 * step[1]
        p = 1 / (1 + np.exp(-(slope * margin + shift)))
        best, threshold = -1.0, 0.5
        for t in np.linspace(0.1, 0.9, 33):
            hit = ((p >= t) & (yv > 0)).sum()
            # What is missed counts somewhat more than what is taken in vain.
            f1 = (1 + BETA**2) * hit / max(1, (p >= t).sum() + BETA**2 * yv.sum())
            if f1 > best + 1e-9 or f1 > best - 1e-9 and abs(t - 0.5) < abs(threshold - 0.5):
                best, threshold = f1, float(t)
        for name, own in (("corpus", ~from_made), ("made", from_made)):
            hit = ((p >= threshold) & (yv > 0) & own).sum()
            print(f"  {kind}, {name}: recall {hit / max(1, (yv[own] > 0).sum()):.3f}, precision {hit / max(1, ((p >= threshold) & own).sum()):.3f}", file=sys.stderr)
        print(f"{kind}: {len(data)} candidates, {sum(r[1] for r in data)} right; held out: F(1.5) {best:.4f} at {threshold:.3f}", file=sys.stderr)
        out[kind] = {
            "base": round(base, 4), "never": never, "rates": rates, "start": round(start, 5), "slope": round(float(slope), 5), "shift": round(float(shift), 5), "threshold": round(threshold, 3),
            "trees": [[f.tolist(), [round(float(c), 5) if np.isfinite(c) else 1e9 for c in cut], [round(float(v), 5) for v in value]] for f, cut, value in trees],
        }
    return out


def main(path: str) -> None:
    texts = pd.read_parquet(path, columns=["doc_id", "text"]).dropna().sort_values("doc_id")["text"].tolist()
    texts = [t for t in texts if not held_out(t)]
    if len(texts) > SAMPLE:
        texts = [texts[i] for i in np.random.default_rng(7).choice(len(texts), SAMPLE, replace=False)]
    MODEL.write_text(json.dumps(train(texts), ensure_ascii=False, separators=(",", ":")), encoding="utf-8")


if __name__ == "__main__":
    main(sys.argv[1])
