"""PII: keyed surrogates of the same type and format.

Entities are found per document: e-mail addresses, phone numbers, IP addresses (both versions), card numbers
(with a valid check digit), social security numbers, bank accounts (IBAN), access keys, secrets given as
name = value (the whole value, however long), and names after a title. Each is replaced by a surrogate that a
keyed permutation makes from the value itself: letters stay letters of their case, digits digits, hex hex,
marks and spacing stay, cards and IBANs stay valid, phones keep their country code, e-mails their top-level
domain, names follow the title's gender and the script.

Coreference: the same value gets the same surrogate wherever it stands. E-mail addresses are one value in any
case, IPv6 addresses in any notation. A name is a family name, and a given name within it: "Mr. John Smith",
"Mr. Smith", and in a document that has one of these a bare "John Smith", "Smith" or "John" share their parts.
Distinctness: within a format a permutation can't send two values to one. What a permutation can't exclude,
surrogates that meet across formats or equal some real value, is checked over all documents: distinct entities
are counted with their surrogates, and those that collide draw again until none does (after DRAWS draws the
operator raises). Only entities that drew again (very few) travel to their texts, by a join on the text's
hash; all others are replaced where they are found. Texts are read twice and, while there is no such entity,
never shuffled.

The key comes from the caller. Whoever has it can invert the permutations, so it isn't in the source.

Not found: names without a title anywhere in their document, birth dates, postal addresses, passport numbers,
national phone numbers in other groupings than those of _PHONE.

Null texts stay null, empty ones empty, texts without entities come back unchanged. Rows without doc_id are
treated like others; repeated rows repeat their result. Time and memory grow with a text's length, not its
square. Empty tables give empty results. Other columns stay as they are, whatever their names; with counted,
n_entities replaces a column of that name.
"""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import re
import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

KEY_SETTING = "spark.corpusmill.pii.key"
ROUNDS, DRAWS, PIECE = 8, 30, 64

# Titles before a name, by gender.
MALE = ("Mr", "Herr", "Sr", "Señor", "M", "Monsieur", "Don", "г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Sra", "Señora", "Srta", "Mme", "Madame", "Mlle", "Doña", "г-жа")
NEITHER = ("Dr", "Dra", "Prof", "Professor", "Profesor", "Doktor", "Docteur")
# Given names of surrogates, by script and gender.
GIVEN = {
    ("latin", "m"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Nico", "Oscar", "Paul"),
    ("latin", "f"): ("Ada", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Irene", "Julia", "Klara", "Laura", "Maria", "Nora", "Olga", "Paula"),
    ("cyrillic", "m"): ("Адам", "Борис", "Виктор", "Денис", "Егор", "Иван", "Марк", "Павел"),
    ("cyrillic", "f"): ("Алла", "Вера", "Дарья", "Елена", "Инна", "Мария", "Нина", "Ольга"),
}
# Syllables of surrogate family names, by script.
SYLLABLES = {
    "latin": tuple(a + b for a in "bdfgklmnprstvz" for b in "aeiou"),
    "cyrillic": tuple(a + b for a in "бвгдзклмнпрст" for b in "аеиоу"),
}

_EMAIL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+\-]{0,62}[A-Za-z0-9_%+\-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}\b")
_SECRET = re.compile(r"(?i:(password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|auth))[\"']?\s{0,3}([=:])\s{0,3}(?:\"([^\"\n]+)\"|'([^'\n]+)'|([^\s\"'<>]+))")
_ACCESS = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)")
_IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){1,7}(?::|[0-9A-Fa-f]{1,4})(?::?[0-9A-Fa-f]{1,4}){0,7}(?![\w:])")
_SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
_CARD = re.compile(r"(?<![\d.])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?!\d)")
_PHONE = re.compile(r"(?<![\w.+])(?:\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\) ?\d{3,4}[ .-]\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4}|\d{3} \d{3} \d{4}|0\d{2,4}[ /-]\d{6,8})(?!\d)")
_PROPER = r"(?:[A-ZÄÖÜÉÈÁÍÓÚÑ][a-zäöüßéèêáíóúñ]{1,30}|[А-Я][а-яё]{1,30})"
_NAME = re.compile(rf"(?<!\w)({'|'.join(map(re.escape, sorted(MALE + FEMALE + NEITHER, key=len, reverse=True)))})(\.? )(?:({_PROPER}) )?({_PROPER}(?:-{_PROPER})?)(?!\w)")
_DIGIT = re.compile(r"\d")
_WORDY = re.compile(r"[A-Za-z]+")
ISSUERS = "23456"  # Fixed value: first digits of payment cards


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    """Whole values after a secret's name: to the closing quote, else to white space. Plain words count after = or a password's name only."""
    for m in _SECRET.finditer(text):
        group = next(g for g in (3, 4, 5) if m.group(g) is not None)
        a, b = m.span(group)
        if group == 5:
            b = a + len(m.group(5).rstrip(",;.)]}"))
        value = text[a:b]
        least = 5 if m.group(2) == "=" or m.group(1).lower() in ("password", "passwd", "pwd") else 7
        if len(value) >= least and (least == 5 or not _WORDY.fullmatch(value)) and any(c.isalnum() for c in value):
            yield a, b


def _card(value: str) -> bool:
    digits = "".join(c for c in value if c.isdigit())
    return digits[0] in ISSUERS and luhn(digits[:-1]) == int(digits[-1])


def _address(value: str) -> bool:
    try:
        return value.count(":") >= 2 and len(ipaddress.IPv6Address(value).exploded) > 0 and bool(_DIGIT.search(value)) and len(value) > 5
    except ValueError:
        return False


def _apart(found: list[tuple]) -> list[tuple]:
    """Spans in order; where two overlap, that of the kind that is listed first stays."""
    taken: list[tuple[int, tuple]] = []
    for order, span in sorted(enumerate(found), key=lambda x: (x[1][0], x[0])):
        while taken and span[0] < taken[-1][1][1] and order < taken[-1][0]:
            taken.pop()
        if not taken or span[0] >= taken[-1][1][1]:
            taken.append((order, span))
    return [span for _, span in taken]


def _named(text: str) -> list[tuple[int, int, str, str]]:
    """Names after a title, and in the same text the bare ones that they explain."""
    titled = [(m, "m" if m.group(1) in MALE else "f" if m.group(1) in FEMALE else "x") for m in _NAME.finditer(text)]
    if not titled:
        return []
    gender: dict[str, str] = {}
    for m, sex in titled:
        if m.group(3) and gender.get(full := f"{m.group(3)} {m.group(4)}", "x") == "x":
            gender[full] = sex
    found = []
    for m, sex in titled:
        value = text[m.start(3) if m.group(3) else m.start(4) : m.end(4)]
        found.append((m.end(4) - len(value), m.end(4), f"name_{gender.get(value, sex)}", value))
    families = {m.group(4): sex for m, sex in titled}
    givens: dict[str, set[str]] = {}
    for full in gender:
        givens.setdefault(full.split(" ")[0], set()).add(full)
    bare = sorted({*gender, *families, *(g for g, fulls in givens.items() if len(fulls) == 1)}, key=len, reverse=True)
    begins = [a for a, *_ in found]
    for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, bare))})(?!\w)", text):
        at = bisect.bisect_right(begins, m.start()) - 1
        if at >= 0 and m.start() < found[at][1]:
            continue
        value = m.group()
        if value in gender:
            found.append((*m.span(), f"name_{gender[value]}", value))
        elif value in families:
            found.append((*m.span(), f"name_{families[value]}", value))
        else:
            full = next(iter(givens[value]))
            found.append((*m.span(), f"given_{gender[full]}", full))
    return found


def _spans(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of all entities, in order and apart. The value is what identifies the entity."""
    if not text:
        return []
    found: list[tuple[int, int, str, str]] = []

    def add(kind: str, spans) -> None:
        found.extend((a, b, kind, text[a:b]) for a, b in spans)

    if "@" in text:
        found += [(*m.span(), "email", m.group().lower()) for m in _EMAIL.finditer(text)]
    if "=" in text or ":" in text:
        add("secret", _secrets(text))
    if _DIGIT.search(text):
        if "AKIA" in text or "ASIA" in text:
            add("access", (m.span() for m in _ACCESS.finditer(text)))
        add("iban", (m.span() for m in _IBAN.finditer(text) if iban_valid(m.group())))
        add("ip", (m.span() for m in _IP.finditer(text)))
        if ":" in text:
            found += [(*m.span(), "ip6", str(ipaddress.IPv6Address(m.group()))) for m in _IP6.finditer(text) if _address(m.group())]
        add("ssn", (m.span() for m in _SSN.finditer(text)))
        add("card", (m.span() for m in _CARD.finditer(text) if _card(m.group())))
        # a phone number ends where another entity begins
        pieces, at = [], 0
        for a, b, *_ in sorted(found):
            if a >= at:
                pieces += [text[at:a], "_" * (b - a)]
                at = b
        rest = "".join(pieces) + text[at:]
        add("phone", (m.span() for m in _PHONE.finditer(rest) if 7 <= sum(c.isdigit() for c in m.group()) <= 15))
    found += _named(text)
    return _apart(found) if len(found) > 1 else found


def entities(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all entities, in order and apart; where two overlap, the kind that is listed first wins."""
    return [(a, b, kind) for a, b, kind, _ in _spans(text)]


def _parts(text: str, span: tuple[int, int, str, str]) -> list[tuple[int, int, str, str]]:
    """What of an entity has a surrogate of its own: the given name (within its full name) and the family name."""
    a, b, kind, value = span
    if not kind.startswith("name"):
        return [span]
    given, space, family = value.rpartition(" ")
    if not space:
        return [(a, b, "family", family)]
    return [(a, a + len(given), f"given_{kind[-1]}", value), (b - len(family), b, "family", family)]


def luhn(digits: str) -> int:
    """Check digit for the digits before it."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + (i % 2 == 0))
        total += d - 9 * (d > 9)
    return -total % 10


def iban_valid(value: str) -> bool:
    compact = value.replace(" ", "")
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


class Keyed:
    """Permutations of strings over an alphabet, from a key and a tweak."""

    def __init__(self, key: str):
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()

    def number(self, tweak: str, bits: int = 128) -> int:
        return int.from_bytes(hashlib.blake2b(tweak.encode("utf-8", "surrogatepass"), key=self.key, digest_size=16).digest()) % (1 << bits)

    def permute(self, symbols: list[int], radix: int, tweak: str) -> list[int]:
        """One to one for each length; long strings in pieces, each under what the pieces before became."""
        out: list[int] = []
        chain = tweak
        for at in range(0, len(symbols), PIECE):
            out += self._permute(symbols[at : at + PIECE], radix, chain)
            if at + PIECE < len(symbols):
                chain = f"{tweak}|{at}|{self.number(f'{chain}|{out[at:]}')}"
        return out

    def _permute(self, symbols: list[int], radix: int, tweak: str) -> list[int]:
        """A balanced Feistel network over the digits of a number in this radix."""
        n = len(symbols)
        if n == 0:
            return []
        if n == 1:
            return [(symbols[0] + 1 + self.number(f"{tweak}|{radix}|1") % (radix - 1)) % radix] if radix > 1 else symbols
        half = n // 2
        size = (radix**half, radix ** (n - half))
        value = 0
        for s in symbols:
            value = value * radix + s
        a, b = divmod(value, size[1])
        for i in range(ROUNDS):
            if i % 2:
                b = (b + self.number(f"{tweak}|{radix}|{n}|{i}|{a}")) % size[1]
            else:
                a = (a + self.number(f"{tweak}|{radix}|{n}|{i}|{b}")) % size[0]
        value, out = a * size[1] + b, []
        for _ in range(n):
            value, s = divmod(value, radix)
            out.append(s)
        return out[::-1]

    def text(self, value: str, tweak: str, all_of_it: bool = False) -> str:
        """Digits to digits, letters to letters of the same case; all else stays (all_of_it: other letters and digits become ASCII ones)."""
        kinds: dict[str, list[int]] = {}
        for i, c in enumerate(value):
            for name in ALPHABETS:
                if c in name:
                    kinds.setdefault(name, []).append(i)
        out = list(value)
        shape = hashlib.blake2b("".join("9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in value).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
        for name, at in kinds.items():
            for i, s in zip(at, self.permute([name.index(value[i]) for i in at], len(name), f"{tweak}|{shape}")):
                out[i] = name[s]
        if all_of_it and (other := [i for i, c in enumerate(value) if c.isalnum() and not c.isascii()]):
            fill = hashlib.shake_128(f"{self.number(f'{tweak}|{value}')}".encode()).digest(len(other))
            for i, byte in zip(other, fill):
                out[i] = ALPHABETS[1][byte % 26]
        return "".join(out)


ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
HEX = "0123456789abcdef"


def surrogate(value: str, kind: str, draw: int = 0, keyed: Keyed | None = None) -> str:
    """The replacement of a value; draw > 0: another one."""
    keyed = keyed or Keyed("")
    tweak = f"{kind}|{draw}"
    if kind == "email":
        local, _, domain = value.lower().partition("@")
        labels = domain.split(".")
        new = f"{keyed.text(local, tweak + '|local')}@{'.'.join(keyed.text(x, f'{tweak}|domain') for x in labels[:-1])}.{labels[-1]}"
        return dressed(new, kind, value)
    if kind == "ip6":
        number = int(ipaddress.IPv6Address(value))
        low = keyed.permute([number >> s & 15 for s in range(108, -4, -4)], 16, f"{tweak}|{number >> 112}")
        return dressed(str(ipaddress.IPv6Address((number >> 112 << 112) | int("".join(HEX[s] for s in low), 16))), kind, value)
    if kind == "ip":
        number = 0
        for x in value.split("."):
            number = number * 256 + int(x)
        usable = lambda n: 0 < n >> 24 < 224 and n >> 24 != 127
        was = usable(number)
        for _ in range(64):  # walk the cycle back into the addresses that hosts have
            octets = keyed.permute([number >> 24, number >> 16 & 255, number >> 8 & 255, number & 255], 256, tweak)
            number = (octets[0] << 24) + (octets[1] << 16) + (octets[2] << 8) + octets[3]
            if usable(number) or not was:
                break
        return ".".join(str(number >> s & 255) for s in (24, 16, 8, 0))
    if kind in ("card", "ssn", "phone"):
        at = [i for i, c in enumerate(value) if c.isdigit()]
        if kind == "phone" and value.startswith("+"):
            code = re.match(r"\+\d{1,3}(?=[ .(-])", value)
            at = [i for i in at if i >= (code.end() if code else 3)]
        digits = [int(value[i]) for i in at]
        body = digits
        checked = kind == "card" and luhn("".join(map(str, digits[:-1]))) == digits[-1]
        kept = 1 if kind == "card" else 0
        if checked:
            body = digits[:-1]
        head, rest = body[:kept], body[kept:]
        least = 2 if kind == "phone" and rest and rest[0] >= 2 else 1 if rest and rest[0] >= 1 else 0
        new = rest
        for _ in range(200):
            new = keyed.permute(new, 10, f"{tweak}|{checked}|{head}")
            if not new or kind == "card" or new[0] >= least:
                break
        new = head + new
        if checked:
            new.append(luhn("".join(map(str, new))))
        out = list(value)
        for i, d in zip(at, new):
            out[i] = str(d)
        return "".join(out)
    if kind == "iban":
        compact = value.replace(" ", "")
        body = keyed.text(compact[4:], tweak + compact[:2])
        check = 98 - int("".join(str(int(c, 36)) for c in body + compact[:2] + "00")) % 97
        chars = iter(f"{compact[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(chars) for c in value)
    if kind == "access":
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
        return value[:4] + "".join(letters[s] for s in keyed.permute([letters.index(c) for c in value[4:]], 36, tweak))
    if kind == "secret" and all(c in HEX for c in value):
        return "".join(HEX[s] for s in keyed.permute([HEX.index(c) for c in value], 16, tweak))
    script = "cyrillic" if re.match(r"[А-Яа-яё]", value) else "latin"
    if kind.startswith("name"):
        given, space, family = value.rpartition(" ")
        return (surrogate(value, f"given_{kind[-1]}", draw, keyed) + space if space else "") + surrogate(family, "family", draw, keyed)
    if kind.startswith("given"):
        number = keyed.number(f"{tweak}|{value}", 60)
        number, first = divmod(number, 2)
        names = GIVEN[script, kind[-1] if kind[-1] != "x" else "mf"[first]]
        chosen = []
        for _ in range(1 + min(draw // 6, 3)):  # a family with very many given names takes double ones
            number, first = divmod(number, len(names))
            chosen.append(names[first])
        return "-".join(chosen)
    if kind == "family":
        syllables, number, parts = SYLLABLES[script], keyed.number(f"{tweak}|{value}", 60), []
        for _ in range(4):
            number, s = divmod(number, len(syllables))
            parts.append(syllables[s])
        return "".join(parts).capitalize()
    return keyed.text(value, tweak, kind == "secret")


def dressed(new: str, kind: str, original: str) -> str:
    """A surrogate in the notation of this mention: the case of an e-mail address, the length of an IPv6 address."""
    if kind == "email" and not original.islower():
        return "".join(n.upper() if o.isupper() else n for n, o in zip(new, original))
    if kind == "ip6" and len(original) == 39:
        return ipaddress.IPv6Address(new).exploded
    return new


def replaced(text: str | None, keyed: Keyed, again: dict[tuple[str, str], str] | None = None, memory: dict | None = None) -> tuple[str | None, int]:
    """The text with surrogates, and how many entities it had."""
    spans = _spans(text)
    if not spans:
        return text, 0
    out, at, again = [], 0, again or {}
    memory = {} if memory is None else memory
    for a, b, kind, value in (part for span in spans for part in _parts(text, span)):
        new = again.get((kind, value)) or memory.get((kind, value))
        if new is None:
            if len(memory) > 50_000:
                memory.clear()
            new = memory[kind, value] = surrogate(value, kind, 0, keyed)
        out += [text[at:a], dressed(new, kind, text[a:b])]
        at = b
    return "".join(out) + text[at:], len(spans)


def found_entities(docs: DataFrame) -> DataFrame:
    """text_key (a hash of the text), kind, value: the distinct entities of each text, names by their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(key, *x) for x in sorted({part[2:] for span in _spans(text) for part in _parts(text, span)})]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))], ["text_key", "kind", "value"])

    return docs.select(F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "text_key long, kind string, value string")


def drawn(rows: DataFrame, key: str) -> DataFrame:
    """kind, value, draw -> the same, surrogate and mark: what must not be twice (of a given name: with its family name)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = Keyed(key)
        for batch in batches:
            kinds, values, draws = (batch.column(i).to_pylist() for i in range(3))
            new = [surrogate(v, k, d, keyed) for k, v, d in zip(kinds, values, draws)]
            marks = [f"{n} {v.rpartition(' ')[2]}" if k.startswith("given") else n for k, v, n in zip(kinds, values, new)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string()), pa.array(marks, pa.string())], ["kind", "value", "draw", "surrogate", "mark"])

    return rows.select("kind", "value", "draw").mapInArrow(run, "kind string, value string, draw int, surrogate string, mark string")


def assign(spark: SparkSession, distinct: DataFrame, key: str = "") -> DataFrame:
    """kind, value, draw, surrogate for distinct (kind, value): no surrogate twice, none that is a real value.

    Kinds are compared by what stands in the text, so a collision across kinds counts too.
    """
    now = stored(spark, drawn(distinct.withColumn("draw", F.lit(0)), key), "surrogates")
    real = now.where("NOT startswith(kind, 'given')").select(F.col("value").alias("mark")).distinct()
    for _ in range(DRAWS):
        # of those that share a surrogate the first keeps it
        shared = now.groupBy("mark").agg(F.count("*").alias("n"), F.min(F.struct("kind", "value")).alias("keeper")).where("n > 1")
        shared = stored(spark, shared.select("mark", "keeper"), "shared-surrogates")
        taken = stored(spark, now.join(real, "mark", "left_semi").select("kind", "value"), "taken-surrogates")
        if shared.isEmpty() and taken.isEmpty():
            return now
        losers = now.join(shared, "mark").where(F.struct("kind", "value") != F.col("keeper")).select("kind", "value").union(taken).distinct()
        losers = stored(spark, losers.withColumn("lost", F.lit(True)), "losing-surrogates")
        marked = now.join(losers, ["kind", "value"], "left")
        redrawn = drawn(marked.where("lost").withColumn("draw", F.col("draw") + 1), key)
        now = stored(spark, marked.where("lost IS NULL").select("kind", "value", "draw", "surrogate", "mark").union(redrawn), "surrogates")
    raise RuntimeError(f"surrogates still collide after {DRAWS} draws")


def session_key(spark: SparkSession) -> str:
    """The key in spark.corpusmill.pii.key; where none is set, a random one for this session, which is never written."""
    if not (key := spark.conf.get(KEY_SETTING, "")):
        spark.conf.set(KEY_SETTING, key := secrets.token_hex(32))
    return key


def with_surrogates(spark: SparkSession, docs: DataFrame, key: str, counted: bool = False) -> DataFrame:
    """docs with every entity of text replaced (and n_entities, if counted); its other columns stay."""
    if not key:
        raise ValueError("surrogates need a key")
    names = list(docs.columns)
    seen = stored(spark, found_entities(docs), "entities")
    finals = assign(spark, seen.select("kind", "value").distinct(), key)
    again = finals.where("draw > 0").select("kind", "value", "surrogate")
    again = seen.join(again, ["kind", "value"]).distinct().groupBy(F.col("text_key").alias("_again_key")).agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias("_again"))
    again = stored(spark, again, "redrawn")
    if again.isEmpty():
        given = docs.withColumn("_again", F.lit(None).cast(again.schema["_again"].dataType))
    else:
        given = docs.join(again, F.xxhash64("text") == F.col("_again_key"), "left").drop("_again_key")
    schema = T.StructType([*docs.drop("n_entities").schema.fields, T.StructField("n_entities", T.IntegerType())]) if counted else docs.schema
    at = names.index("text")
    kept = [n for n in names if not (counted and n == "n_entities")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed, memory = Keyed(key), {}
        for batch in batches:
            texts, counts = [], []
            for text, more in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                new, n = replaced(text, keyed, {(x["kind"], x["value"]): x["surrogate"] for x in more or []}, memory)
                texts.append(new)
                counts.append(n)
            columns = {n: batch.column(i) for i, n in enumerate(names)} | {"text": pa.array(texts, pa.string())}
            if counted:
                columns["n_entities"] = pa.array(counts, pa.int32())
            order = kept + ["n_entities"] * counted
            yield pa.RecordBatch.from_arrays([columns[n] for n in order], order)

    return given.mapInArrow(run, schema)
