"""Surrogates for personal data: detected entities get keyed replacements of their own type, gender, script and format.

An entity is what its canonical form says: case, composed or decomposed accents, the spacing of numbers and leading
zeros of addresses don't count, so "John Smith" and "JOHN SMITH" are one. Each kind maps canonical forms one to one by a
keyed permutation without fixed points, and the surrogate is written in the case and format of the text it replaces:

* names go part by part. A given name of a list becomes another of its list, which has one script and gender; so do
  family names; any other part has its letters permuted, vowels and consonants each among themselves, its last letter
  kept, as that often carries the gender, until no list holds the result;
* phone numbers, cards and bank accounts permute their digits. A country code stays, and a card or account that passes
  its check is replaced by one that passes, one that fails by one that fails;
* addresses of four octets permute within their kind: each private range, loopback, link-local, or public;
* of e-mail addresses the local part and every label of the host but the last are permuted.

So by construction an entity has one surrogate wherever and however it is written, a name's or host's part is replaced
alike inside longer ones, and no two entities share a surrogate. ``surrogate_collisions`` checks all of that over the
entities of a corpus; the query and the pipeline run it and fail if it finds any. A surrogate may equal an entity that
some other text holds, as it must where a kind has few forms; ``surrogates_in_use`` lists those.

A name is detected behind a title, or where a given name of a list stands before a capitalised word. In the same text
its bare repeats and those of its parts, as written or all in capitals, are replaced alike. Other names pass.

Defined results: a null text stays null; overlapping finds go to the kind listed first; rows with an equal text are
replaced alike; null and repeated ids are ordinary; columns other than ``text`` and ``n_chars`` pass unchanged; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import secrets
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookloom.llm.common import map_batches

#: The setting that holds the key, in hexadecimal digits. Without it each session draws its own.
KEY_SETTING = "spark.brookloom.pii.key"
_DRAWN: dict[str, bytes] = {}


def session_key(spark: SparkSession) -> bytes:
    """The key of KEY_SETTING, else a secret of this session that is written nowhere: its surrogates can't be undone,
    nor be repeated by another session."""
    held = spark.conf.get(KEY_SETTING, None)
    return bytes.fromhex(held) if held else _DRAWN.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


#: Given names by script and gender, and family names by script. No name is in two lists.
GIVEN = {
    "latin male": "james john robert michael william david richard joseph thomas charles daniel matthew anthony steven andrew peter paul kevin brian george edward henry hans klaus jürgen wolfgang stefan dieter pierre jacques antoine olivier laurent étienne josé carlos miguel javier alejandro pablo",
    "latin female": "mary jane patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy margaret sandra emily donna michelle carol amanda rebecca laura helen anna maria ursula sabine heike birgit monika petra isabelle nathalie sylvie céline camille carmen lucía pilar elena beatriz",
    "cyrillic male": "иван пётр алексей дмитрий сергей николай андрей михаил владимир александр",
    "cyrillic female": "анна мария ольга елена наталья татьяна светлана ирина екатерина людмила",
    "greek male": "γιώργος νίκος δημήτρης κώστας γιάννης παναγιώτης",
    "greek female": "ελένη κατερίνα σοφία δήμητρα βασιλική αγγελική",
}
FAMILY = {
    "latin": "smith johnson williams brown jones miller davis wilson anderson taylor moore jackson thompson white harris clark lewis robinson walker hall doe müller schmidt schneider fischer weber meyer wagner becker hoffmann schulz dubois moreau lefèvre fournier girard garcía martínez lópez sánchez gonzález pérez",
    "cyrillic": "иванов петров сидоров кузнецов смирнов попов волков соколов",
    "cyrillic female": "иванова петрова сидорова кузнецова смирнова попова волкова соколова",
    "greek": "παπαδόπουλος οικονόμου νικολάου γεωργίου δημητρίου ιωάννου",
}
_LISTS = {f"given {k}": v.split() for k, v in GIVEN.items()} | {f"family {k}": v.split() for k, v in FAMILY.items()}
_LISTED = {name: (k, i) for k, names in _LISTS.items() for i, name in enumerate(names)}
_GIVEN = frozenset(name for name, (k, _) in _LISTED.items() if k.startswith("given"))

_EDGE, _END = r"(?<![\w@.+-])", r"(?![\w@])"
_WORD = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
_MALE = r"Mr|Mister|Sir|Herr|Señor|Sr|Monsieur|Don"
_FEMALE = r"Mrs|Ms|Miss|Madam|Frau|Señora|Señorita|Sra|Srta|Madame|Mme|Mlle|Doña"
TITLES = f"{_FEMALE}|{_MALE}|Dr|Prof"
#: In order of precedence. A kind is looked for only in texts that hold one of its hints.
PATTERNS = {
    "email": (re.compile(rf"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{{2,}}(?![\w-])", re.A), ("@",)),
    "iban": (re.compile(rf"{_EDGE}[A-Z]{{2}}\d\d(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_END}", re.A), ()),
    "phone": (re.compile(rf"(?<![\w.+-])(?:\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,4}}(?:[ .-]?\d{{2,4}}){{1,3}}|\(\d{{3}}\) ?\d{{3}}[ .-]\d{{4}}|\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}})(?![\w.-]?\d|\w)", re.A), ()),
    "card": (re.compile(r"(?<![\w.+-])(?:\d{4}[ -]?){3}\d{4}(?![\w-]|\.\d)|(?<![\w.+-])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?![\w-]|\.\d)", re.A), ()),
    "ssn": (re.compile(r"(?<![\w.+-])\d{3}-\d{2}-\d{4}(?![\w-])", re.A), ("-",)),
    "ip": (re.compile(r"(?<![\w.+-])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w-]|\.\d)", re.A), (".",)),
    "name": (re.compile(rf"(?<!\w)(?:{TITLES})\.?[  ]((?!(?:{TITLES})\b)(?=[^\W\d_a-z])(?:[^\W\d_]\.|{_WORD})(?:[  ](?=[^\W\d_])(?=\S*)(?:[A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ]\.|[A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ][^\W\d_]*(?:[-'’][^\W\d_]+)*)){{0,3}})"), tuple(TITLES.split("|"))),
}
KINDS = tuple(PATTERNS)
_DIGITS = "0123456789"
#: Letters by script and kind, as fixed values.
_LETTERS = (
    "aeiou", "bcdfghjklmnpqrstvwxyz",
    "àáâäãåèéêëìíîïòóôöõùúûü", "çñšžý",
    "αεηιουω", "βγδζθκλμνξπρστφχψ",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь",
)
_RADIX = {c: group for group in (*_LETTERS, _DIGITS) for c in group}


@lru_cache(maxsize=10_000)
def _group(c: str) -> str:
    """The characters that may stand for ``c``: its kind's, or for letters of other scripts those of its category among
    the 64 code points around it. Empty where case or composition would not come back: such characters stay."""
    small = c.lower()
    if small in _RADIX:
        return _RADIX[small]
    whole = lambda x: len(x.upper()) == 1 and x.upper().lower() == x and unicodedata.normalize("NFC", x) == x
    if len(small) != 1 or not small.isalpha() or small.isascii() or not whole(small) or (c != small and c != small.upper()):
        return ""
    kind, base = unicodedata.category(small), ord(small) & ~63
    return "".join(x for x in map(chr, range(base, base + 64)) if unicodedata.category(x) == kind and x not in _RADIX and whole(x))


class Permutation:
    """A keyed permutation of 0..size-1: a Feistel network on the next even number of bits, walked until inside."""

    ROUNDS = 8

    def __init__(self, key: bytes, label: str, size: int):
        self.size, self.half = size, max(1, -(-(size - 1).bit_length() // 2))
        self.key = hashlib.blake2b(f"{label}/{size}".encode(), key=key[:64]).digest()

    def _round(self, i: int, x: int) -> int:
        n = -(-self.half // 8)
        h = hashlib.blake2b(bytes([i]) + x.to_bytes(n, "little"), key=self.key, digest_size=min(64, n + 8)).digest()
        return int.from_bytes(h, "little") & ((1 << self.half) - 1)

    def _walk(self, x: int, rounds: range) -> int:
        mask = (1 << self.half) - 1
        while True:
            a, b = x >> self.half, x & mask
            if rounds.step > 0:
                for i in rounds:
                    a, b = b, a ^ self._round(i, b)
            else:
                for i in rounds:
                    a, b = b ^ self._round(i, a), a
            x = a << self.half | b
            if x < self.size:
                return x

    def __call__(self, x: int) -> int:
        """A conjugate of a shift, so that nothing stays in place: unless there is but one place."""
        if self.size == 1:
            return x
        y = (self._walk(x, range(self.ROUNDS)) + 1) % self.size
        return self._walk(y, range(self.ROUNDS - 1, -1, -1))


def permuted(text: str, key: bytes, label: str, fixed: int = 0) -> str:
    """``text`` with its digits and letters permuted, whatever their case, the last ``fixed`` characters staying."""
    plain = unicodedata.normalize("NFC", text)
    body, tail = (plain[:-fixed], plain[-fixed:]) if fixed else (plain, "")
    groups, value, size = [], 0, 1
    for c in body:
        g = _group(c)
        groups.append(g)
        if g:
            value, size = value * len(g) + g.index(c.lower()), size * len(g)
    shape = "".join(g[0] if g else c.lower() for c, g in zip(body, groups, strict=True))
    value, out = Permutation(key, f"{label}/{shape}/{tail.lower()}", size)(value), []
    for c, g in zip(reversed(body), reversed(groups), strict=True):
        if g:
            value, k = divmod(value, len(g))
            c = g[k].upper() if c.isupper() else g[k]
        out.append(c)
    return "".join(reversed(out)) + tail


def _laid_out(characters: str, text: str) -> str:
    """``characters`` in place of the letters and digits of ``text``."""
    it = iter(characters)
    return "".join(next(it) if c.isalnum() else c for c in text)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(digits: str, key: bytes, label: str) -> str:
    n = len(digits)
    return str(Permutation(key, f"{label}/{n}", 10**n)(int(digits))).zfill(n)


def _card(digits: str, key: bytes) -> str:
    """Permuted until the Luhn check says of the result what it says of the card: the walk stays a permutation."""
    want, out = _luhn(digits), digits
    while True:
        out = _digits(out, key, "card")
        if _luhn(out) == want:
            return out


def _remainder(account: str) -> int:
    """Of an account's country and body by 97, with letters as numbers from 10 and two zeros for the check digits."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:2] + "00")) % 97


def _iban(account: str, key: bytes) -> str:
    """Country and body shape stay; the check digits are as far from the right ones as they were."""
    apart = (int(account[2:4]) - (98 - _remainder(account))) % 100
    out = account[:4] + permuted(account[4:], key, "iban" + account[:2])
    return f"{out[:2]}{(98 - _remainder(out) + apart) % 100:02d}{out[4:]}"


#: Kinds of addresses as (first address, bits that are free), public ones being the rest; fixed values.
NETWORKS = ((10 << 24, 24), (172 << 24 | 16 << 16, 20), (192 << 24 | 168 << 16, 16), (127 << 24, 24), (169 << 24 | 254 << 16, 16))


def _network(x: int) -> tuple[int, int] | None:
    return next(((first, bits) for first, bits in NETWORKS if x >> bits == first >> bits), None)


def _ip(text: str, key: bytes) -> str:
    a, b, c, d = map(int, text.split("."))
    x = a << 24 | b << 16 | c << 8 | d
    if own := _network(x):
        x = own[0] | Permutation(key, f"ip/{own[0]}", 1 << own[1])(x - own[0])
    else:
        walk = Permutation(key, "ip", 1 << 32)
        x = walk(x)
        while _network(x):
            x = walk(x)
    return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


def _name_part(text: str, key: bytes) -> str:
    small = unicodedata.normalize("NFC", text).lower()
    if small in _LISTED:
        k, i = _LISTED[small]
        out = _LISTS[k][Permutation(key, k, len(_LISTS[k]))(i)]
        return out.upper() if text.isupper() else out.capitalize() if text[0].isupper() else out
    while True:
        text = permuted(text, key, "name", 1 if len(text.rstrip(".")) > 2 else 0)
        if text.lower() not in _LISTED:
            return text


def canonical(kind: str, text: str) -> str:
    """The form that an entity has however it is written."""
    if kind == "phone":
        code = re.match(r"\+\d{1,3}(?=[ .-])", text)
        return (code.group() + " " if code else "") + re.sub(r"\D", "", text[code.end() :] if code else text)
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", text)
    if kind == "iban":
        return text.replace(" ", "")
    if kind == "ip":
        return ".".join(str(int(x)) for x in text.split("."))
    return re.sub(r"\s", " ", unicodedata.normalize("NFC", text).lower())


@lru_cache(maxsize=100_000)
def surrogate(kind: str, text: str, key: bytes) -> str:
    """The replacement of an entity."""
    own = canonical(kind, text)
    if kind == "email":
        local, _, host = text.partition("@")
        labels = host.split(".")
        return permuted(local, key, "local") + "@" + ".".join([*(permuted(x, key, "host") for x in labels[:-1]), labels[-1]])
    if kind == "card":
        return _laid_out(_card(own, key), text)
    if kind == "ssn":
        return _laid_out(_digits(own, key, "ssn"), text)
    if kind == "ip":
        return _ip(own, key)
    if kind == "name":
        return re.sub(r"[^\s-]+", lambda m: _name_part(m.group(), key), text)
    if kind == "iban":
        return _laid_out(_iban(own, key), text)
    code, _, digits = own.rpartition(" ")
    return text[: len(code)] + _laid_out(_digits(digits, key, "phone" + code), text[len(code) :])


@dataclass(frozen=True)
class Entity:
    kind: str
    start: int
    end: int
    text: str


_ANY = re.compile(rf"[0-9@]|\b(?:{TITLES})\b")
_CAPITAL = "A-ZÀ-ÖØ-ÞΑ-ΩΆΈΉΊΌΎΏА-ЯЁ"
#: Two capitalised words, initials between; the first is then looked up.
_PAIR = re.compile(rf"(?<!\w)([{_CAPITAL}][^\W\d_]+)(?=((?:[ \u00a0][{_CAPITAL}]\.){{0,2}}(?:[ \u00a0-][{_CAPITAL}][^\W\d_]+(?:[-'’][^\W\d_]+)*){{1,2}})(?!\w))")


def _untitled(text: str) -> list[tuple[int, int]]:
    """Spans of a listed given name and the capitalised words after it."""
    return [(m.start(), m.end(2)) for m in _PAIR.finditer(text) if unicodedata.normalize("NFC", m.group(1)).lower() in _GIVEN]


def _repeats(text: str, found: list[Entity]) -> list[Entity]:
    """Where names that have a title in the text, or parts of them, stand again without; initials count beside a part."""
    words = {y for e in found if e.kind == "name" for x in re.split(r"[\s-]+", e.text) for y in (x, x.upper())}
    either = lambda some: "|".join(re.escape(x) for x in sorted(some, key=lambda x: (-len(x), x)))
    parts, initials = either({x for x in words if len(x.rstrip(".")) > 1}), either({x for x in words if len(x) == 2 and x[1] == "."})
    if not parts:
        return []
    first, more = (rf"(?:(?:{initials})[ \u00a0])*", rf"|{initials}") if initials else ("", "")
    rx = re.compile(rf"(?<!\w){first}(?:{parts})(?!\w)(?:[ \u00a0-](?:(?:{parts})(?!\w){more}))*")
    starts, out = [e.start for e in found], []
    for m in rx.finditer(text):
        k = bisect_right(starts, m.start())
        if (not k or found[k - 1].end <= m.start()) and (k == len(found) or m.end() <= starts[k]):
            out.append(Entity("name", *m.span(), m.group()))
    return out


def entities(text: str) -> list[Entity]:
    """The entities of a text, in order, none overlapping; offsets count code points."""
    pairs = _untitled(text)
    if not pairs and not _ANY.search(text):
        return []
    found: list[Entity] = []

    def add(kind: str, start: int, end: int) -> None:
        end -= 2 * (kind == "name" and text[start:end].endswith(("'s", "’s")))
        if all(end <= e.start or e.end <= start for e in found):
            found.append(Entity(kind, start, end, text[start:end]))

    for kind, (rx, hints) in PATTERNS.items():
        if not hints or any(h in text for h in hints):
            for m in rx.finditer(text):
                add(kind, *m.span(m.lastindex or 0))
    for start, end in pairs:
        add("name", start, end)
    found.sort(key=lambda e: e.start)
    return sorted(found + _repeats(text, found), key=lambda e: e.start)


def replaced(text: str, found: list[Entity], key: bytes) -> str:
    out, at = [], 0
    for e in found:
        out += [text[at : e.start], surrogate(e.kind, e.text, key)]
        at = e.end
    return "".join([*out, text[at:]])


def pii_surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with surrogates, n_entities, a count of each kind, and the original spans, of every row."""
    counts = [f"n_{k}" for k in KINDS]
    schema = "doc_id long, text string, n_entities long, " + ", ".join(f"{c} long" for c in counts) + ", spans string"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, all_found = [], []
        for t in batch.column("text").to_pylist():
            found = entities(t) if t else []
            texts.append(replaced(t, found, key) if found else t)
            all_found.append(found)
        cols = [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array([len(x) for x in all_found], pa.int64())]
        cols += [pa.array([sum(e.kind == k for e in x) for x in all_found], pa.int64()) for k in KINDS]
        cols.append(pa.array([",".join(f"{e.kind}:{e.start}:{e.end}" for e in x) for x in all_found], pa.string()))
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "text", "n_entities", *counts, "spans"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), work, schema)


def with_surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """All rows and columns, personal data in ``text`` replaced; ``n_chars``, where there, counts the new text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [replaced(t, found, key) if t and (found := entities(t)) else t for t in batch.column("text").to_pylist()]
        return batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), pa.array(texts, batch.schema.field("text").type))

    out = map_batches(docs, work, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def entity_table(docs: DataFrame, key: bytes) -> DataFrame:
    """kind, entity and surrogate in canonical form, and n, one row for each distinct entity of the corpus and form of
    its surrogate: there should be one."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(e.kind, canonical(e.kind, e.text), canonical(e.kind, surrogate(e.kind, e.text, key))) for t in batch.column("text").to_pylist() if t for e in entities(t)]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in cols], ["kind", "entity", "surrogate"])

    found = map_batches(docs.select(F.col("text").cast("string").alias("text")), work, "kind string, entity string, surrogate string")
    return found.groupBy("kind", "entity", "surrogate").agg(F.count("*").alias("n"))


def surrogate_collisions(docs: DataFrame, key: bytes) -> DataFrame:
    """kind, problem and value of each surrogate that two entities share or that is its entity, and of each entity with
    two surrogates: none, if all is right."""
    both = F.array(F.struct(F.lit("split").alias("problem"), F.col("entity").alias("value"), F.col("surrogate").alias("other")), F.struct(F.lit("shared").alias("problem"), F.col("surrogate").alias("value"), F.col("entity").alias("other")))
    sides = entity_table(docs, key).select("kind", F.explode(both).alias("x")).groupBy("kind", "x.problem", "x.value").agg(F.min("x.other").alias("least"), F.max("x.other").alias("most"))
    apart = F.when(F.col("least") != F.col("most"), F.col("problem")).when((F.col("problem") == "split") & (F.col("least") == F.col("value")), "unchanged")
    return sides.select("kind", apart.alias("problem"), "value").where("problem is not null")


def checked(docs: DataFrame, key: bytes) -> None:
    """Fail if the corpus has a collision: at most three are shown."""
    if found := surrogate_collisions(docs, key).head(3):
        raise ValueError(f"surrogates collide: {found}")


def surrogates_in_use(docs: DataFrame, key: bytes) -> DataFrame:
    """kind and surrogate of those that are another entity of the corpus."""
    held = entity_table(docs, key).persist()
    return held.select("kind", "surrogate").join(held.select("kind", F.col("entity").alias("surrogate")), ["kind", "surrogate"], "left_semi").distinct()
