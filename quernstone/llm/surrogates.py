"""Surrogates for personal data: keyed, of the same type and form, distinct and consistent.

Detected entities are replaced by others of their kind.  A surrogate is the next
element, in a keyed order, of the finite set of all values of the same form:
with a keyed permutation P of {0 .. N-1}, x becomes P^-1(P(x) + 1 mod N).  That is
one cycle through the whole set, so

* equal values become equal surrogates in every document (coreference),
* different values of a form become different ones (distinctness, by bijection,
  with no table of the corpus and no shuffle),
* no value stays as it is, unless its form has that value alone.

Forms keep what a reader sees: lengths, separators, letter case, the script and
its vowels, a card's issuer digit and check digit, an address's network, a listed
given name's gender and script, and the last letter of any other name, by which
many languages mark gender.  A surrogate goes by the value alone, never by its
surroundings: a title's gender is told in an entity's kind.  A surrogate may equal another original of its text,
whose own surrogate differs from it again; moving it on would give its value two
surrogates in the corpus.

Names are found by titles, by lists of given names and by phrases that introduce
a name; a part of a found name that stands alone elsewhere in the document is the
same person's and is replaced alike.  A name that none of these mark stays.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import ipaddress
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Given names by script and gender.  A name's surrogate comes from its own list.
GIVEN = {
    ("latin", "f"): "Alice Anna Beatrice Carla Carmen Catherine Charlotte Clara Diana Elena Emily Emma Eva Fatima Giulia Grace Hannah Helen Ingrid Isabel Jane Julia Karen Laura Linda Lucia Margaret Maria Marie Martha Mary Monika Nadia Nora Olivia Patricia Rachel Rosa Sarah Sofia Susan Teresa Ursula Vera Victoria Wendy Yvonne Zoe".split(),
    ("latin", "m"): "Adam Ahmed Albert Alexander Andrew Anton Bernard Carlos Charles Daniel David Diego Edward Erik Felix Francis Frank George Hans Henry Hugo Ivan Jack James Jean John Jorge Joseph Juan Karl Louis Lukas Marco Mark Martin Michael Miguel Nicholas Oscar Pablo Paul Peter Philip Pierre Richard Robert Samuel Thomas Victor William".split(),
    ("cyrillic", "f"): "Анна Вера Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Борис Владимир Дмитрий Иван Михаил Николай Сергей".split(),
    ("greek", "f"): "Αγγελική Αθηνά Βασιλική Ελένη Ιωάννα Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Αλέξανδρος Ανδρέας Γιώργος Δημήτρης Κώστας Νίκος Παναγιώτης Χρήστος".split(),
}
_GENDER = {name: (script, gender) for (script, gender), names in GIVEN.items() for name in names}
#: Classes of letters that a pseudonym keeps, letter by letter.
LETTERS = [
    "aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäëïöüæøåãõ", "çñßšžčćśźżłđğş",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αεηιουω", "βγδζθκλμνξπρσςτφχψ", "άέήίόύώ", "0123456789",
]
_UPPER = ["".join(c.upper() for c in s if len(c.upper()) == 1) for s in LETTERS[:-1]]
_ALPHABET = {c: s for s in [*_UPPER, *LETTERS] for c in s}

_NAME = r"[^\W\d_][^\W\d_'’-]*(?:['’-][^\W\d_]+)*"
_TITLES = {"m": r"Mr\.?|Mister|Sir|Herr|Monsieur|M\.|Señor|Sr\.|Don|Signor", "f": r"Mrs\.?|Ms\.?|Miss|Madam|Lady|Frau|Madame|Mme\.?|Mlle\.?|Señora|Sra\.|Señorita|Doña|Signora", "": r"Dr\.?|Prof\.?|Professor"}
_TITLED = {g: re.compile(rf"(?<!\w)(?:{t})[ \t]+({_NAME}(?:[ \t]+{_NAME}){{0,2}})") for g, t in _TITLES.items()}
_INTRODUCED = re.compile(rf"(?<!\w)(?:[Mm]y name is|[Ss]igned by|[Aa]ttn[.:]?|[Mm]e llamo|[Jj]e m'appelle|[Ii]ch heiße)[ \t]+({_NAME}(?:[ \t]+{_NAME}){{0,2}})")
_LISTED = re.compile(rf"(?<!\w)((?:{'|'.join(sorted(_GENDER, key=len, reverse=True))})[ \t]+{_NAME})(?!\w)")
PATTERNS = [
    ("email", re.compile(r"(?<![\w.+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w-])")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("ssn", re.compile(r"(?<![\w-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.+-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[.-])[0-9]{3,4}[ .-][0-9]{3,4}(?![\w-]|\.[0-9])|(?<![\w+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![\w-])")),
    ("local-phone", re.compile(r"(?<!\w)(?i:tel|telephone|phone|call|fax|mobile|cell|dial)(?!\w)[^\n0-9]{0,12}(?<![\w.+-])([0-9]{3}-[0-9]{4})(?![\w-]|\.[0-9])")),
    ("card", re.compile(r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]|\.[0-9])")),
    ("ipv4", re.compile(r"(?<![\w.-])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\w-]|\.[0-9])")),
    ("ipv6", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:.])(?=[A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?![\w:])")),
]
#: Where patterns are tried: around digits that stand close together, and around "@".
_DIGITS, _AT = re.compile(r"[0-9](?:[^0-9\n]{0,3}[0-9])+"), re.compile("@")
_SPACED = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
_TITLE_WORDS = {t.encode() for ts in _TITLES.values() for t in ts.replace("\\.?", "").replace("\\.", "").split("|")}
_INTRODUCTIONS = {b"name", b"by", b"Attn", b"attn", b"llamo", b"appelle", "heiße".encode()}
_NAME_WORDS = {n.encode() for n in _GENDER}


def _windows(text: str, finder: re.Pattern, margin: int) -> list[tuple[int, int]]:
    """Parts of the text around what ``finder`` finds, apart and in order."""
    out: list[list[int]] = []
    for m in finder.finditer(text):
        a, b = max(0, m.start() - margin), min(len(text), m.end() + margin)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def luhn_digit(body: list[int]) -> int:
    """The check digit that follows ``body``."""
    total = sum(d if i % 2 else (d * 2 if d < 5 else d * 2 - 9) for i, d in enumerate(reversed(body)))
    return -total % 10


def luhn(digits: list[int]) -> bool:
    return len(digits) > 1 and luhn_digit(digits[:-1]) == digits[-1]


def ipv6_valid(text: str) -> bool:
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return True


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


class Keyed:
    """A keyed permutation of {0 .. n-1} for each form, and the cycle it gives."""

    def __init__(self, key: bytes, rounds: int = 8):
        self.key, self.rounds = key, rounds

    def _f(self, form: str, r: int, x: int, n: int) -> int:
        size = (n.bit_length() + 7) // 8 + 8
        out, block = b"", 0
        message = f"{form}|{n}|{r}|{x}".encode()
        while len(out) < size:
            out += hmac.digest(self.key, message + block.to_bytes(2, "big"), "sha256")
            block += 1
        return int.from_bytes(out[:size], "big") % n

    def permute(self, form: str, n: int, x: int, back: bool = False) -> int:
        """An unbalanced Feistel network on a * b >= n, walked until it is below n again."""
        if n < 2:
            return x
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            left, right = divmod(x, b)
            for r in range(self.rounds) if not back else reversed(range(self.rounds)):
                sign = -1 if back else 1
                if r % 2 == 0:
                    left = (left + sign * self._f(form, r, right, a)) % a
                else:
                    right = (right + sign * self._f(form, r, left, b)) % b
            x = left * b + right
            if x < n:
                return x

    def after(self, form: str, n: int, x: int) -> int:
        """The next element of the cycle."""
        return self.permute(form, n, (self.permute(form, n, x) + 1) % n, back=True) if n > 1 else x


class Form:
    """The set of all texts that differ from one only in letters and digits of the same classes."""

    def __init__(self, kind: str, text: str, fixed: set[int] = frozenset()):
        self.slots = [(i, _ALPHABET[c]) for i, c in enumerate(text) if i not in fixed and c in _ALPHABET]
        marks = {i for i, _ in self.slots}
        self.text = text
        # the classes and what stays belong to the name, so each form has a cycle of its own
        self.name = kind + ":" + "".join(chr(0xE000 + _INDEX[_ALPHABET[c]]) if i in marks else c for i, c in enumerate(text))
        self.n = 1
        for _, s in self.slots:
            self.n *= len(s)

    def rank(self, text: str) -> int:
        x = 0
        for i, s in self.slots:
            x = x * len(s) + s.index(text[i])
        return x

    def text_of(self, x: int) -> str:
        out = list(self.text)
        for i, s in reversed(self.slots):
            x, d = divmod(x, len(s))
            out[i] = s[d]
        return "".join(out)


_INDEX = {s: i for i, s in enumerate([*_UPPER, *LETTERS])}


def _in_form(keyed: Keyed, kind: str, text: str, good, fixed: set[int] = frozenset()) -> str:
    """The next text of the form, along the cycle, that ``good`` accepts; the cycle over accepted texts is one as well."""
    form = Form(kind, text, fixed)
    x = start = form.rank(text)
    while True:
        x = keyed.after(form.name, form.n, x)
        got = form.text_of(x)
        if x == start or good(got):
            return got


def _digits(text: str) -> list[int]:
    return [int(c) for c in text if c.isascii() and c.isdigit()]


_NETWORKS = [ipaddress.IPv4Network(n) for n in "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4".split()]


def next_value(keyed: Keyed, kind: str, text: str) -> str:
    """The successor of a value among the values of its kind and form."""
    if kind == "email":
        local, _, domain = text.rpartition("@")
        top = domain.rpartition(".")[2]
        keep = set(range(len(text) - len(top) - 1, len(text)))
        return _in_form(keyed, kind, text, lambda t: True, keep) if len(local) + len(domain) > len(top) + 1 else text
    if kind == "card":
        at = [i for i, c in enumerate(text) if c.isdigit()]
        valid = luhn(_digits(text))
        # the issuer's first digit stays; a valid number's check digit follows from the others
        keep = {at[0], at[-1]} if valid else {at[0]}
        if not valid:
            return _in_form(keyed, "card", text, lambda t: not luhn(_digits(t)), keep)
        plain = text[: at[-1]] + "0" + text[at[-1] + 1 :]
        got = _in_form(keyed, "card-valid", plain, lambda t: True, keep)
        return got[: at[-1]] + str(luhn_digit(_digits(got)[:-1])) + got[at[-1] + 1 :]
    if kind == "local-phone":
        return _in_form(keyed, kind, text, lambda t: True)
    if kind == "phone":
        country = re.match(r"\+[0-9]{1,3}(?=[ .-])", text)
        return _in_form(keyed, kind, text, lambda t: True, set(range(country.end())) if country else set())
    if kind == "ssn":
        ok = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}")
        return _in_form(keyed, kind, text, lambda t: bool(ok.fullmatch(t)))
    if kind == "iban":
        body = text[:2] + "00" + text[4:]
        got = _in_form(keyed, kind, body, lambda t: True, {0, 1, 2, 3})
        s = got.replace(" ", "")
        check = 98 - int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97
        return got[:2] + f"{check:02d}" + got[4:]
    if kind == "ipv4":
        address = ipaddress.IPv4Address(".".join(str(int(p)) for p in text.split(".")))
        # an address of a special network stays in it, and others stay outside all of them
        for net in _NETWORKS:
            if address in net:
                return str(net[keyed.after(str(net), net.num_addresses, int(address) - int(net[0]))])
        x = int(address)
        while True:
            x = keyed.after("ipv4", 1 << 32, x)
            if not any((got := ipaddress.IPv4Address(x)) in net for net in _NETWORKS):
                return str(got)
    if kind == "ipv6":
        # groups keep their lengths and places, and "::" its own
        got = ":".join(f"{keyed.after('ipv6-' + str(i) + ':' + str(len(p)), 16 ** len(p), int(p, 16)):0{len(p)}x}" if p else "" for i, p in enumerate(text.lower().split(":")))
        return got.upper() if text != text.lower() else got
    if kind.startswith("given-"):
        listed = GIVEN[_GENDER[text]]
        return listed[keyed.after(kind, len(listed), listed.index(text))]
    # the last letter stays: many languages mark gender there; a title's gender is no part of the form
    return _in_form(keyed, f"name-{script_of(text)}", text, lambda t: t not in _GENDER, {len(text) - 1} if len(text) > 3 else set())


def script_of(text: str) -> str:
    c = next((c for c in text if c.isalpha()), "a")
    return "cyrillic" if "Ѐ" <= c <= "ԯ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def name_kind(part: str, gender: str) -> str:
    """A listed given name's list, or else a pseudonym's kind with the title's ``gender``, if that is known.

    A listed name has its own gender whatever the title's: a surname that is a
    given name too has one surrogate in all texts.
    """
    if part in _GENDER:
        script, own = _GENDER[part]
        return f"given-{script}-{own}"
    return f"name-{script_of(part)}" + (f"-{gender}" if gender else "")


class Spans:
    """Spans that do not overlap, in order; each look-up is a binary search."""

    def __init__(self):
        self.starts: list[int] = []
        self.spans: list[tuple[int, int, str]] = []

    def add(self, a: int, b: int, kind: str) -> None:
        """Adds a span unless a part of it is taken."""
        i = bisect.bisect_left(self.starts, a)
        if (i < len(self.starts) and self.starts[i] < b) or (i and self.spans[i - 1][1] > a):
            return
        self.starts.insert(i, a)
        self.spans.insert(i, (a, b, kind))


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all entities, apart and in order; a name gives one for each of its parts."""
    # a title or a listed name always is a whole run of word characters, as the patterns see them
    words = set(text.encode().translate(_SPACED).split()) if text.isascii() else {w.encode("utf-8", "surrogatepass") for w in re.findall(r"\w+", text)}
    titled, listed, introduced = (not words.isdisjoint(x) for x in (_TITLE_WORDS, _NAME_WORDS, _INTRODUCTIONS))
    near = {"email": _windows(text, _AT, 330)} if "@" in text else {}
    digits = _windows(text, _DIGITS, 48)
    taken, valid = Spans(), {"iban": iban_valid, "ipv6": ipv6_valid}
    for kind, pattern in PATTERNS:
        for window in near.get(kind, ()) if kind == "email" else digits:
            for m in pattern.finditer(text, *window):
                own = m.re.groups  # the number alone, where the pattern has what introduces it
                if kind not in valid or valid[kind](m.group(own)):
                    taken.add(*m.span(own), kind)
    parts: dict[str, str] = {}
    names = [(m, g, 1) for g, p in _TITLED.items() for m in p.finditer(text)] if titled else []
    names += [(m, "", 1) for m in _LISTED.finditer(text)] if listed else []
    names += [(m, "", 1) for m in _INTRODUCED.finditer(text)] if introduced else []
    for m, gender, group in names:
        for p in re.finditer(_NAME, m.group(group)):
            if not p.group()[0].isupper():
                break
            parts.setdefault(p.group(), name_kind(p.group(), gender))
            taken.add(m.start(group) + p.start(), m.start(group) + p.end(), parts[p.group()])
    if parts:  # the same person again, by a part of the name
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(parts, key=len, reverse=True)))})(?!\w)", text):
            taken.add(*m.span(), parts[m.group()])
    return taken.spans


def replace(text: str, keyed: Keyed) -> tuple[str, list[tuple[int, int, str]], int]:
    """The text with surrogates, the entities' places in the original, and how many of its values share a surrogate with another: none, as each form is one cycle."""
    spans = find(text)
    if not spans:
        return text, spans, 0
    made = written(text, spans, keyed)
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], made[kind, text[a:b]]]
        at = b
    values = {(value, got) for (_, value), got in made.items()}
    return "".join([*out, text[at:]]), spans, len(values) - len({got for _, got in values})


def written(text: str, spans: list[tuple[int, int, str]], keyed: Keyed) -> dict[tuple[str, str], str]:
    """The surrogate of each kind and value among the entities of a text."""
    return {(kind, value): next_value(keyed, kind, value) for kind, value in sorted({(kind, text[a:b]) for a, b, kind in spans})}


def default_key(secret: str) -> bytes:
    return hashlib.sha256(secret.encode()).digest()


def surrogate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", secret: str = "change me") -> DataFrame:
    """(id, text, n_entities, entities, n_collisions) for every row: the whole text with surrogates.

    ``entities`` lists kind:start:end (code points of the original text, end
    exclusive), comma-joined.  Null texts stay null and have no entity; empty
    ones and ones without personal data stay as they are.  Rows that repeat give
    the same result each.  One narrow pass.
    """
    keyed = Keyed(default_key(secret))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for k in range(0, b.num_rows, 500):
                s = b.slice(k, 500)
                done = [(None, [], 0) if t is None else replace(t, keyed) for t in s.column(1).to_pylist()]
                yield pa.record_batch([
                    s.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([len(d[1]) for d in done], pa.int64()),
                    pa.array([",".join(f"{kind}:{a}:{b}" for a, b, kind in d[1]) for d in done], pa.string()), pa.array([d[2] for d in done], pa.int64()),
                ], names=["id", "text", "n_entities", "entities", "n_collisions"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, text string, n_entities long, entities string, n_collisions long")
    return out.withColumnRenamed("id", id_col)


def collisions(docs: DataFrame, text_col: str = "text", secret: str = "change me") -> DataFrame:
    """(kind, surrogate_sha256, n): surrogates that stand for several originals anywhere in the corpus; distinctness leaves none.

    Digests only leave the texts; they are counted with partial aggregation.
    """
    keyed = Keyed(default_key(secret))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = set()
            for t in b.column(0).to_pylist():
                rows.update((kind, v, got) for (kind, v), got in written(t, find(t), keyed).items())
            made = [(kind, hashlib.sha256(v.encode()).hexdigest(), hashlib.sha256(got.encode()).hexdigest()) for kind, v, got in sorted(rows)]
            yield pa.record_batch([pa.array([m[i] for m in made], pa.string()) for i in range(3)], names=["kind", "original", "surrogate_sha256"])

    pairs = docs.select(common.text_or_empty(text_col).alias("text")).mapInArrow(run, "kind string, original string, surrogate_sha256 string").distinct()
    return pairs.groupBy("kind", "surrogate_sha256").agg(F.count("*").alias("n")).where("n > 1")
