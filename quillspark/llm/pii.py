"""Personal data: detection, and keyed surrogates that keep type, gender, script and format.

Detected: e-mail and IPv4 addresses, telephone and card numbers, social security numbers, IBANs, and names of persons
(words in title or upper case, with initials and particles between them, after an honorific or after a known given name, and later
mentions of the same words in the document). An occurrence is brought to a normal form (digits alone, lower case), which is what
a surrogate is made for: so all mentions, in whatever format and beside whatever honorific, keep their coreference, and the
occurrence's own format (separators, case, hyphens) is poured over the surrogate.

A known given name becomes another known one of the same gender and script, by a keyed cycle. Every other value is a number in the
space of its shape: each digit, letter, vowel or consonant of a script may become any of its kind; the rest stays (separators,
country codes, top-level domains, leading zeros, endings that show gender), and check digits are computed. A keyed Feistel
network permutes that space; the surrogate is the value's neighbour in that order, so distinct values have distinct surrogates by
construction and none stays itself. Collision check over the whole corpus: if a surrogate is a real value of its type, or has
been taken, its owner goes on to the next place of the order. Where a shape is too crowded for that (some value finds none in
``ROUNDS`` steps) all its values take their first neighbours: still distinct, but some may be others' real values.

A linear search tells texts that cannot hold a find, which are most. Documents without a find pass through unshuffled. Only the rest are
staged, and joined to surrogates value by value. Defined results: null and empty texts are kept as they are; repeated rows stay, rewritten
alike; a null id is kept; a very long text is searched whole; a value without a character that can change stays; an empty table gives
an empty result; all other columns are carried.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import secrets
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import column_function, narrow, small_batches, stage

#: For tests alone.
KEY = b"surrogates"
ROUNDS = 8
#: Rounds of the Feistel network.
_FEISTEL = 10

#: Given names by gender and script, honorifics by gender, particles of names.
GIVEN = {
    ("f", "latin"): "Alice Amelia Andrea Anna Barbara Beatriz Camille Carmen Carolina Catherine Charlotte Claire Clara Elena Elisabeth Emily Emma Eva Helen Inés Isabel Jane Jennifer Julia Karin Katharina Laura Linda Lucía Manon Margaret María Marie Mary Monika Nathalie Olivia Patricia Petra Rosa Sabine Sandra Sarah Sofía Sophie Susan Teresa Ursula".split(),
    ("m", "latin"): "Andreas Antoine Antonio Carlos Charles Christian Daniel David Diego Edward Fernando François Frank George Hans Henri Jacques James Javier Jean John Jorge José Jürgen Karl Klaus Louis Luis Manuel Marc Matthias Michael Miguel Nicolas Olivier Pablo Paul Peter Philippe Pierre Rafael Richard Robert Stefan Thomas Walter William Wolfgang".split(),
    ("f", "cyrillic"): "Анна Валентина Екатерина Елена Ирина Людмила Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("m", "cyrillic"): "Александр Алексей Андрей Борис Виктор Владимир Дмитрий Иван Михаил Николай Павел Сергей".split(),
    ("f", "greek"): "Αγγελική Αικατερίνη Αναστασία Βασιλική Γεωργία Ελένη Ιωάννα Μαρία Σοφία".split(),
    ("m", "greek"): "Αθανάσιος Βασίλειος Γεώργιος Δημήτριος Ιωάννης Κωνσταντίνος Νικόλαος Παναγιώτης Χρήστος".split(),
}
HONORIFICS = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "u", "Prof": "u", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Don": "m", "Doña": "f", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f"}
PARTICLES = "da de del den der di du la le van von".split()
#: Characters that may stand for each other.
KINDS_OF_LETTER = ("aeiouy", "bcdfghjklmnpqrstvwxz", "àáâãäåæèéêëìíîïòóôõöøùúûüýÿ", "çðñþ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "ъь", "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ")
_DIGIT, _FIRST_DIGIT, _LETTER = "0123456789", "123456789", "abcdefghijklmnopqrstuvwxyz"
_LIKE = {c: k for k in KINDS_OF_LETTER for c in k}
#: First octets of addresses, but those of private networks and of this machine, which stay.
_OCTETS = [i for i in range(1, 224) if i not in (10, 127)]

_GENDER = {name: (gender, script) for (gender, script), names in GIVEN.items() for name in names}
_U, _L = "A-ZÀ-ÖØ-ÞΆ-ΫА-ЯЁ", "a-zß-öø-ÿά-ώа-яё"
_CAP = rf"(?:[{_U}]['’])?(?:[{_U}][{_L}]+(?:[{_U}][{_L}]+)?|[{_U}]{{2,}})"
_WORD = rf"{_CAP}(?:-{_CAP})*"
_TITLES = "|".join(sorted({y for x in HONORIFICS for y in (x, x.upper())}, key=len, reverse=True))
_RUN = re.compile(rf"(?<![\w.@-])(?:(?:(?:{_TITLES})\.|[{_U}]\.|{_WORD}|{'|'.join(PARTICLES)})[ \n])+{_WORD}(?![\w@])")
_LATIN = [n for n in (*_GENDER, *HONORIFICS) if n.isascii() or "À" <= max(n) <= "ÿ"]
#: What every text with a find matches, for a search in linear time.
_ANY = (
    r"@|[0-9][0-9 .()\-]{5}|[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"
    + rf"|\b(?:{'|'.join(_LATIN)})(?:[^a-z]|$)|\b(?:{'|'.join(n.upper() for n in _LATIN)})(?:[^A-Z]|$)"
    + "|" + "|".join(x for n in (*_GENDER, *HONORIFICS) if n not in _LATIN for x in (n, n.upper()))
)
_EMAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]+@(?:[\w-]+\.)+[^\W\d_]{2,}")
_IP = re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)", re.ASCII)
_CARD = re.compile(r"(?<![\d+-])\d(?:[ -]?\d){12,18}(?!\d)", re.ASCII)
_SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", re.ASCII)
_IBAN = re.compile(r"(?<![A-Z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])", re.ASCII)
_PHONE = re.compile(r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])", re.ASCII)
_DIGITS = re.compile(r"\d", re.ASCII)
_SOME_DIGITS = re.compile(r"\d[\d .()-]{5}", re.ASCII)

Entity = tuple[int, int, str]


def script(text: str) -> str:
    for c in text:
        if "Ͱ" <= c <= "Ͽ":
            return "greek"
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
    return "latin"


def luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def _iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def _phone(m: re.Match[str]) -> re.Match[str] | None:
    """The match, or its longest form that ends with a group of digits and has 7 to 15; a card number that follows is left out."""
    form: re.Match[str] | None = m
    text, end = m.string, m.end()
    if len(_DIGITS.findall(m[0])) > 15:
        for i in range(m.start() + 1, m.end()):
            c = _CARD.match(text, i) if text[i - 1] == " " else None
            if c and luhn("".join(_DIGITS.findall(c[0]))):
                end = i
                break
        form = _PHONE.match(text, m.start(), end)
    while form and (len(_DIGITS.findall(form[0])) > 15 or form.end() < len(text) and re.match(r"\w", text[form.end()])):
        form = _PHONE.match(text, m.start(), form.end() - 1)
    return form if form and len(_DIGITS.findall(form[0])) >= 7 and (form[0][0] == "+" or not form[0].isdigit()) else None


def known_as(word: str) -> str | None:
    """The known given name that a word is, in title or upper case."""
    return word if word in _GENDER else word.capitalize() if word.isupper() and word.capitalize() in _GENDER else None


def _gender(word: str) -> str | None:
    """Of a known given name, or of one that hyphens make of such."""
    found = [known_as(w) for w in word.split("-")]
    return _GENDER[found[0]][0] if all(found) else None


def _names(run: str) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """(gender of the honorific or "", (start, end, word) of each word and initial) of the names in a run of words.

    A name begins after an honorific, or at a known given name that another word follows, and ends where the next begins:
    given names in a row are one name's. It has up to three words without an honorific and four with one, or one more than
    its given names; initials, and particles before a word, do not count.
    """
    words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^ \n]+", run) if m[0] not in PARTICLES]
    last = len(words) - 1
    titles = [w.removesuffix(".") for _, _, w in words]
    called = [HONORIFICS.get(t, HONORIFICS.get(t.capitalize()) if t.isupper() else None) if i < last else None for i, t in enumerate(titles)]
    initial = [len(w) == 2 and w[1] == "." for _, _, w in words]
    given = [not i and _gender(w) is not None for i, (_, _, w) in zip(initial, words, strict=True)]
    at, gender = 0, ""
    while at <= last:
        if called[at]:
            gender, at = called[at] if called[at] != "u" or not gender else gender, at + 1
            continue
        if not gender and (not given[at] or at == last or called[at + 1]):
            at += 1
            continue
        end = at
        while end <= last and (given[end] or initial[end]):
            end += 1
        most = max(at + (4 if gender else 3), end + 1)
        while end <= last and end < most and not called[end] and not (given[end] and end < last and not called[end + 1]):
            most += initial[end]
            end += 1
        yield gender, words[at:end]
        at, gender = end, ""


def detect(text: str) -> list[Entity]:
    """(start, end, type) of every entity, apart from each other, in order of start."""
    found: list[Entity] = []

    def meets(start: int, end: int) -> Entity | None:
        """The first entity that a span overlaps."""
        i = bisect.bisect_left(found, (start,))
        if i and found[i - 1][1] > start:
            return found[i - 1]
        return found[i] if i < len(found) and found[i][0] < end else None

    def add(start: int, end: int, kind: str) -> None:
        if meets(start, end) is None:
            bisect.insort(found, (start, end, kind))

    def add_numbers(pattern: re.Pattern[str], kind: str, shorter: Callable[[re.Match[str]], re.Match[str] | None]) -> None:
        """Of each match the part before the next entity, in a form that shorter accepts."""
        at = 0
        while m := pattern.search(text, at):
            other = meets(m.start(), m.end())
            form: re.Match[str] | None = m
            if other:
                form = pattern.match(text, m.start(), other[0]) if other[0] > m.start() else None
            form = form and shorter(form)
            if form:
                add(form.start(), form.end(), kind)
            at = form.end() if form else other[1] if other and other[0] <= m.start() else m.start() + 1

    if "@" in text:
        for m in _EMAIL.finditer(text):
            add(m.start(), m.end(), "email")
    for m in _IBAN.finditer(text):
        v = m[0].replace(" ", "")
        if _iban_check(v[:2], v[4:]) == v[2:4]:
            add(m.start(), m.end(), "iban")
    if _SOME_DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(int(x) < 256 for x in m[0].split(".")):
                add(m.start(), m.end(), "ip")
        for m in _SSN.finditer(text):
            add(m.start(), m.end(), "ssn")
        add_numbers(_PHONE, "phone", _phone)
        add_numbers(_CARD, "card", lambda m: m)
    known: dict[str, str] = {}
    for m in _RUN.finditer(text):
        for honoured, words in _names(m[0]):
            parts, gender = [(m.start() + s, m.start() + e, w) for s, e, w in words], honoured or "u"
            for i, (s, e, w) in enumerate(parts):
                if w[-1] == ".":
                    add(s, s + 1, "initial")
                    continue
                if i < len(parts) - 1 or len(parts) == 1 and _gender(w):
                    kind = f"given_{_gender(w) or gender}"
                else:
                    kind = f"surname_{_gender(parts[0][2]) or gender if len(parts) > 1 else gender}" if script(w) != "latin" else "surname"
                add(s, e, kind)
                known |= {w: kind, w.upper(): kind}
    if known:
        for m in re.finditer(rf"(?<![\w@.-])(?:{'|'.join(map(re.escape, sorted(known, key=len, reverse=True)))})(?![\w@])", text):
            add(m.start(), m.end(), known[m[0]])
    return found


def family(kind: str, value: str) -> str:
    """What surrogates are made for: known given names and other words of names are apart, whoever bears them."""
    if kind.startswith(("given", "surname")):
        return "given" if _gender(value.title() if value.islower() else value) else "name"
    return kind


def normal(kind: str, value: str) -> str:
    """What all ways to write a value have in common."""
    if kind in ("phone", "card", "ssn"):
        digits = "".join(_DIGITS.findall(value))
        return (f"+{re.match(r'[+](\d{1,3})', value)[1]}|" if value[0] == "+" else "") + digits
    if kind == "iban":
        return value.replace(" ", "")
    if kind.startswith(("given", "surname")) and _gender(value):
        return "-".join(known_as(w) for w in value.split("-"))
    low = value.lower()
    return low if len(low) == len(value) and kind != "ip" else value


def _places(kind: str, value: str) -> list[str]:
    """For each character, those it may become; "" if it stays."""
    free = {c: _LETTER for c in _LETTER} | {c: _DIGIT for c in _DIGIT}
    if kind == "email":
        local, _, domain = value.partition("@")
        labels = domain.split(".")
        kept = len(".".join(labels[-2:] if labels[-2] == "example" else labels[-1:]))  # a reserved domain stays so
        return [free.get(c, _LIKE.get(c, "")) if i < len(value) - kept else "" for i, c in enumerate(value)]
    if kind == "iban":
        return ["" if i < 4 else _DIGIT if c.isdigit() else c.isalpha() and _LETTER.upper() or "" for i, c in enumerate(value)]
    if kind in ("phone", "card", "ssn"):
        country, bar, digits = value.rpartition("|")
        first = len(country) + len(bar) + (len(country) - 1 if bar else kind == "card")
        out = ["" if i < first else _DIGIT for i in range(len(value))]
        if kind == "card" and luhn(digits):
            out[-1] = ""
        if first < len(value) and (first == 0 or value[first - 1] == "|"):  # zeros at the front stay, other digits don't become one
            out[first] = _FIRST_DIGIT if value[first] != "0" else ""
        return out
    low = value.lower()
    out = [_DIGIT if c in _DIGIT else _LIKE.get(b, "").upper() if c.isupper() else _LIKE.get(c, "") for c, b in zip(value, low, strict=True)]
    out[_stem(kind, value) :] = [""] * (len(value) - _stem(kind, value))
    return out


def _stem(kind: str, value: str) -> int:
    """How many characters go before the ending of a name, which shows gender and stays: with and without it the same stem has the same surrogate."""
    n = len(value)
    if kind != "name":
        return n
    ending = {"latin": 1, "greek": 2}.get(script(value), 3 if value[-1].lower() in "ая" else 2)
    return n - ending if n > ending + 2 else n


class Surrogates:
    """Surrogates of normal forms under a key."""

    def __init__(self, key: bytes):
        self.key = hashlib.sha512(key).digest()
        self.next: dict[str, str] = {}
        for names in GIVEN.values():
            order = sorted(names, key=lambda n: self._number(b"cycle", 0, len(names), n.encode(), 1 << 64))
            self.next |= zip(order, order[1:] + order[:1], strict=True)

    def _number(self, shape: bytes, turn: int, size: int, value: bytes, below: int) -> int:
        """A keyed pseudo-random number."""
        out, need = b"", below.bit_length() // 8 + 9
        while len(out) < need:
            out += hashlib.blake2b(b"%d|%d|%d|%d|" % (turn, size, len(shape), len(out)) + shape + value, key=self.key).digest()
        return int.from_bytes(out[:need], "big") % below

    def _permuted(self, x: int, a: int, b: int, shape: bytes, back: bool) -> int:
        """A keyed permutation of the numbers below a * b."""
        left, right = divmod(x, b)
        as_bytes = lambda n: n.to_bytes(n.bit_length() // 8 + 1, "big")
        for turn in reversed(range(_FEISTEL)) if back else range(_FEISTEL):
            sign = -1 if back else 1
            if turn % 2:
                right = (right + sign * self._number(shape, turn, a, as_bytes(left), b)) % b
            else:
                left = (left + sign * self._number(shape, turn, b, as_bytes(right), a)) % a
        return left * b + right

    def _moved(self, digits: list[int], sizes: list[int], shape: bytes, step: int) -> list[int]:
        """The numbers that are ``step`` places on in the order of a keyed permutation of all that sizes allow."""
        half = len(sizes) // 2
        x, a, b = 0, 1, 1
        for i, (d, n) in enumerate(zip(digits, sizes, strict=True)):
            x = x * n + d
            a, b = (a * n, b) if i < half else (a, b * n)
        if a * b == 1:
            return digits
        x = self._permuted((self._permuted(x, a, b, shape, False) + step) % (a * b), a, b, shape, True)
        out = []
        for n in reversed(sizes):
            x, d = divmod(x, n)
            out.append(d)
        return out[::-1]

    def shape(self, kind: str, value: str, stem: bool = False) -> str:
        """What the surrogate of a value has in common with it; surrogates of values that differ in it differ. Of a name, perhaps without its ending."""
        kind = family(kind, value)
        if kind == "ip":
            first = int(value.split(".")[0])
            return "ip|" + (str(first) if first not in _OCTETS else "")
        computed = range(2, 4) if kind == "iban" else range(len(value) - 1, len(value)) if kind == "card" and luhn(value) else ()
        parts = [f"[{p}]" if p else c if i not in computed else "*" for i, (c, p) in enumerate(zip(value, _places(kind, value), strict=True))]
        return f"{kind}|" + "".join(parts[: _stem(kind, value)] if stem else parts)

    def __call__(self, kind: str, value: str, step: int = 1) -> str:
        kind = family(kind, value)
        if kind == "given":
            return "-".join(self.next[w] for w in value.split("-"))
        shape = self.shape(kind, value, True).encode("utf-8", "surrogatepass")
        if kind == "ip":
            octets = [int(x) for x in value.split(".")]
            free = octets[0] in _OCTETS
            new = self._moved([_OCTETS.index(octets[0]) if free else 0, *octets[1:]], [len(_OCTETS) if free else 1, 256, 256, 256], shape, step)
            return ".".join(map(str, [_OCTETS[new[0]] if free else octets[0], *new[1:]]))
        places = _places(kind, value)
        at = [i for i, p in enumerate(places) if p]
        new, out = self._moved([places[i].index(value[i]) for i in at], [len(places[i]) for i in at], shape, step), list(value)
        for i, d in zip(at, new, strict=True):
            out[i] = places[i][d]
        done = "".join(out)
        if kind == "card" and luhn(value):
            done = next(x for x in (done[:-1] + d for d in _DIGIT) if luhn(x))
        return done[:2] + _iban_check(done[:2], done[4:]) + done[4:] if kind == "iban" else done


@lru_cache(maxsize=4)
def surrogates(key: bytes) -> Surrogates:
    return Surrogates(key)


@lru_cache(maxsize=1)
def _own_key() -> bytes:
    return secrets.token_bytes(32)


def session_key(spark: SparkSession) -> bytes:
    """spark.quillspark.pii.key of the session; where it is unset a random one, kept by the driver's Python and by nobody else."""
    given = spark.conf.get("spark.quillspark.pii.key", None)
    return given.encode() if given else _own_key()


def pour(kind: str, value: str, new: str) -> str:
    """The surrogate of a value's normal form in the format of the value."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(new.rpartition("|")[2])
        return "".join(next(digits) if c.isascii() and c.isdigit() else c for c in value)
    if kind == "iban":
        chars = iter(new)
        return "".join(c if c == " " else next(chars) for c in value)
    if len(new) == len(value):
        return "".join(b.upper() if a.isupper() else b.lower() if a.islower() else b for a, b in zip(value, new, strict=True))
    return new.upper() if value.isupper() else new


_ENTITIES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("family", pa.string()), ("value", pa.string())]))
_ENTITY = "array<struct<start: int, `end`: int, kind: string, family: string, value: string>>"


def _found(column: pa.Array) -> pa.Array:
    """Entities of each text."""
    some = pc.fill_null(pc.match_substring_regex(column, _ANY), False).to_pylist()
    out = []
    for i, may in enumerate(some):
        text = column[i].as_py() if may else ""
        row = []
        for s, e, k in detect(text) if may else ():
            v = normal(k, text[s:e])
            row.append({"start": s, "end": e, "kind": k, "family": family(k, v), "value": v})
        out.append(row)
    return pa.array(out, _ENTITIES)


def assigned(values: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value), free of clashes but where a shape is too crowded. Kinds are families."""

    def attempt(df: DataFrame, step: int) -> DataFrame:
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            make, rows = surrogates(key), []
            for k, v in zip(*(c.to_pylist() for c in b.columns[:2]), strict=True):
                new = make(k, v, step)
                rows.append((k, v, new, make.shape(k, v), family(k, v) == "given", family(k, v) == "name" and _gender(new.title()) is not None))
            types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["kind", "value", "surrogate", "shape", "given", "bad"])

        return narrow(df.select("kind", "value"), batch, "kind string, value string, surrogate string, shape string, given boolean, bad boolean")

    values = stage(values.select("kind", "value"), "values")
    real = values.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("real"))
    taken, left = None, values
    for step in range(1, ROUNDS + 1):
        tried = attempt(left, step).join(real, ["kind", "surrogate"], "left")
        lost = F.coalesce("real", F.lit(False)) | F.col("bad")
        if taken is not None:
            tried = tried.join(taken.select("kind", "surrogate", F.lit(True).alias("taken")), ["kind", "surrogate"], "left")
            lost = lost | F.coalesce("taken", F.lit(False))
        judged = stage(tried.select("kind", "value", "surrogate", "shape", (lost & ~F.col("given")).alias("lost")), "judged")
        kept = judged.where("not lost").drop("lost")
        taken = kept if taken is None else taken.union(kept)
        left = judged.where("lost")
        if not left.limit(1).count():
            return taken.select("kind", "value", "surrogate")
    crowded = stage(left.select("kind", "shape").distinct(), "crowded")
    first = attempt(values, 1).select("kind", "value", "surrogate", "shape").join(crowded, ["kind", "shape"], "left_semi")
    return taken.join(crowded, ["kind", "shape"], "left_anti").select("kind", "value", "surrogate").union(first.select("kind", "value", "surrogate"))


def replace(docs: DataFrame, *, text_col: str = "text", key: bytes | None = None, entities_col: str | None = None) -> DataFrame:
    """The documents, all columns, with surrogates in the text; with ``entities_col``, also the array of (start, end, kind) in the old text."""
    key = session_key(docs.sparkSession) if key is None else key
    cols = docs.columns
    text = F.col(f"`{text_col}`").cast("string")
    listed = lambda found: F.transform(found, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), f["kind"].alias("kind")))
    find = column_function(_found, _ENTITY)
    clean = small_batches(docs).where(F.size(find(text)) == 0)
    if entities_col:
        clean = clean.withColumn(entities_col, F.expr("cast(array() as array<struct<start: int, `end`: int, kind: string>>)"))
    row = F.struct(F.lit(0).alias("__0"), *[F.col(f"`{c}`") for c in cols if c != text_col]).alias("__row")
    some = docs.select(text.alias("__text"), row).withColumn("__found", find("__text")).where(F.size("__found") > 0)
    some = stage(some.withColumn("__uid", F.monotonically_increasing_id()), "personal")
    mentions = some.select("__uid", F.explode(F.array_distinct(F.transform("__found", lambda f: F.struct(f["family"].alias("kind"), f["value"].alias("value"))))).alias("m")).select("__uid", "m.kind", "m.value")
    values = assigned(mentions.select("kind", "value").distinct(), key)
    by_row = mentions.join(values, ["kind", "value"]).groupBy("__uid").agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias("__new"))

    def rewrite(texts: pa.Array, founds: pa.Array, news: pa.Array) -> pa.Array:
        out = []
        for text, found, new in zip(*(x.to_pylist() for x in (texts, founds, news)), strict=True):
            of, parts, at = {(n["kind"], n["value"]): n["surrogate"] for n in new}, [], 0
            for f in found:
                s, e = f["start"], f["end"]
                parts += [text[at:s], pour(f["kind"], text[s:e], of[f["family"], f["value"]])]
                at = e
            out.append("".join([*parts, text[at:]]))
        return pa.array(out, pa.string())

    done = some.join(by_row, "__uid").withColumn("__done", column_function(rewrite, "string")("__text", "__found", "__new"))
    more = [listed("__found").alias(entities_col)] if entities_col else []
    return clean.union(done.select(*[F.col("__done").alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in cols], *more))
