"""PII: detected entities get surrogates that are keyed, of the same type and format, and distinct wherever the originals are.

A surrogate is made by format-preserving encryption of the entity's normal form: each character moves within its own kind
(digits, vowels or consonants of its script, other letters of its part of Unicode, given names of one gender), so script, case, punctuation, length and gender stay.
The encryption is a keyed permutation conjugated with a shift: one to one, never the identity, and the same in every document,
so mentions of one entity stay mentions of one. A check over all entities of the corpus confirms that no two share a
surrogate; were there any, everything would be made anew under the next tweak of the key.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyproof.llm.common import arrow_map, documents, materialize, payloads

#: The session's setting that holds the key of op10_pii, and the key of synthetic tables, which protects nothing.
KEY_SETTING, EXAMPLE_KEY = "spark.storyproof.pii.key", "for synthetic tables only"
ROUNDS = 8
#: Letters or digits that are moved together.
BLOCK = 64
ENTITY = "array<struct<kind:string,start:int,end:int,original:bigint,surrogate:bigint>>"

# Given names by script and gender, and the titles that announce a name.
GIVEN = {
    ("latin", "f"): "Anna Maria Emma Olivia Sophia Isabella Charlotte Amelia Julia Laura Sarah Elena Claudia Martina Camille Juliette Margaux Katharina Johanna Friederike Lucia Carmen Pilar Mercedes Elizabeth Jennifer Patricia Linda Barbara Susan Jessica Karen Nancy Michelle".split(),
    ("latin", "m"): "John James Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Edward George Edmond Louis Pierre Jacques François Antoine Hans Klaus Jürgen Wolfgang Stefan Juan Carlos José Miguel Diego Alejandro Francisco Peter Paul".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Екатерина Светлана Юлия".split(),
    ("cyrillic", "m"): "Иван Александр Сергей Дмитрий Андрей Алексей Николай Михаил Владимир Павел".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Ιωάννα".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Νίκος Κώστας Παναγιώτης Ιωάννης".split(),
}
TITLES = {"f": "Mrs Ms Miss Madame Mme Mademoiselle Mlle Frau Señora Señorita Sra Srta Lady Госпожа Κυρία".split(), "m": "Mr Mister Sir Monsieur Herr Señor Sr Lord Господин Κύριος M".split(), "n": "Dr Prof Professor Doctor Captain Capitaine Doktor".split()}
PARTICLES = "de du des da di do dos del della la le van von der den ten ter zu bin ibn al el".split()
LETTERS = {"latin": ("aeiou", "bcdfghjklmnpqrstvwxyz"), "cyrillic": ("аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ"), "greek": ("αεηιουω", "βγδζθκλμνξπρστφχψ")}
KINDS = [*(x for pair in LETTERS.values() for x in pair), "0123456789"]
KIND_OF = {c: k for k in KINDS for c in k}

_CAPITAL = r"[^\W\d_a-zß-öø-ÿа-яёα-ω]"
_NAME = _CAPITAL + r"[^\W\d_]+"
#: A name as it is written together: Dupont, O'Brien, d'Artagnan, Jean-Luc.
_WORD = rf"(?:(?:{_CAPITAL}|[dl])['’])?{_NAME}(?:[-'’]{_NAME})*"
_PARTICLES = rf"(?:(?:{'|'.join(PARTICLES)}) )*"
_GIVEN = {n: (script, gender, i) for (script, gender), names in GIVEN.items() for i, n in enumerate(names)}
_TITLE_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
EMAIL = re.compile(r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w-])")
PHONE = re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w.+-])(?:\+?1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\w-])")
IPV4 = re.compile(r"(?<![\w.-])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w-]|\.\d)", re.ASCII)
CARD = re.compile(r"(?<![\w.+-])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,4}(?:\d{3})?(?![\w-])", re.ASCII)
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.ASCII)
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.ASCII)
PERSON = re.compile(rf"(?<!\w)(?:(?:(?P<title>M(?=\.)|{'|'.join(sorted(set(_TITLE_GENDER) - {'M'}, key=len, reverse=True))})\.? +)+(?P<names>{_PARTICLES}{_WORD}(?: {_PARTICLES}{_WORD})?)|(?P<given>{'|'.join(sorted(_GIVEN, key=len, reverse=True))}) (?P<family>{_PARTICLES}{_WORD}))(?!\w)")
_MENTION = re.compile(rf"(?<![\w'’-]){_WORD}(?![\w-])")


def _luhn(digits: str) -> int:
    """What the last digit is off from the one that the Luhn rule asks for."""
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(digits[-2::-1]))
    return (int(digits[-1]) + total) % 10


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


@lru_cache(maxsize=1 << 14)
def _round(tweak: str, i: int, half: int, bits: int) -> int:
    digest = hashlib.blake2b(f"{tweak}/{i}/{bits}/".encode() + half.to_bytes(bits // 8 + 1), digest_size=64).digest()
    return int.from_bytes(digest * (bits // 512 + 1)) & ((1 << bits) - 1)


def _permuted(x: int, bits: int, tweak: str, back: bool = False) -> int:
    """A Feistel network over numbers of 2 * bits bits."""
    left, right = x >> bits, x & ((1 << bits) - 1)
    for i in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
        if back:
            left, right = right ^ _round(tweak, i, left, bits), left
        else:
            left, right = right, left ^ _round(tweak, i, right, bits)
    return left << bits | right


def moved(x: int, n: int, tweak: str) -> int:
    """A keyed one-to-one map of range(n) onto itself that leaves no number in its place (for n over 1)."""
    if n < 2:
        return x
    bits = max(1, ((n - 1).bit_length() + 1) // 2)
    shift = 1 + int.from_bytes(hashlib.blake2b(f"shift/{tweak}/".encode() + n.to_bytes(n.bit_length() // 8 + 1)).digest()) % (n - 1)

    def walk(y: int, back: bool = False) -> int:
        y = _permuted(y, bits, tweak, back)
        while y >= n:
            y = _permuted(y, bits, tweak, back)
        return y

    return walk((walk(x) + shift) % n, back=True)


@lru_cache(maxsize=1)
def _other_kinds() -> dict[str, str]:
    """The kind of each letter beyond KINDS that a name can hold: letters of the same 128 code points and the same sort.

    Letters with two cases are there in lower case. Those that would be alone are together, so that any can move.
    """
    groups: dict[tuple, list[str]] = {}
    for c in filter(re.compile(r"[^\W\d_]").match, map(chr, range(sys.maxunicode + 1))):
        if c not in KIND_OF and _low(c) == c:
            cased = c.upper() != c and _low(c.upper()) == c
            groups.setdefault((cased or unicodedata.category(c), re.match(_NAME, c * 2) is not None, ord(c) >> 7), []).append(c)
    for level in (2, 1, 0):
        alone = [k for k, v in groups.items() if len(v) == 1]
        for k in alone:
            groups.setdefault(k[:level], []).extend(groups.pop(k))
    return {c: "".join(v) for v in groups.values() for c in v}


def _low(c: str) -> str:
    """c in lower case where that and back again are one to one, else c itself."""
    low = c.lower()
    return low if len(low) == 1 and low.upper() == c else c


@lru_cache(maxsize=1 << 14)
def _kind(c: str) -> str | None:
    """The letters or digits that c moves among, in lower case; nothing for what is neither."""
    low = _low(c)
    return KIND_OF.get(low) or (_other_kinds().get(low) if c.isalnum() else None)


def shuffled(text: str, tweak: str) -> str:
    """text with every letter or digit moved within its kind and case; what belongs to no kind stays.

    Long texts are moved BLOCK letters or digits at a time. Each block's tweak holds the surrogates before it, which whoever
    undoes them knows, so the whole map is one to one, too, and its work is linear in the text.
    """
    places = [(i, kind) for i, c in enumerate(text) if (kind := _kind(c))]
    of = dict(places)
    shape = "".join("." if i not in of else str(KINDS.index(of[i])) if of[i] in KINDS else f"[{ord(of[i][0]):x}]" for i in range(len(text)))
    out, key = list(text), f"{tweak}/{shape}"
    for lo in range(0, len(places), BLOCK):
        part = places[lo : lo + BLOCK]
        x, n = 0, 1
        for i, kind in part:
            x, n = x * len(kind) + kind.index(_low(text[i])), n * len(kind)
        y = moved(x, n, key)
        for i, kind in reversed(part):
            y, d = divmod(y, len(kind))
            out[i] = kind[d].upper() if _low(text[i]) != text[i] else kind[d]
        if lo + BLOCK < len(places):
            key = hashlib.blake2b("".join([key, "/", *(out[i] for i, _ in part)]).encode("utf-8", "replace")).hexdigest()
    return "".join(out)


def _digits(text: str, f: Callable[[str], str]) -> str:
    """text with its digits replaced by what f makes of them, in ASCII; each stays in its script."""
    found = [(i, c) for i, c in enumerate(text) if c.isdecimal()]
    out = list(text)
    for (i, c), d in zip(found, f("".join(str(int(c)) for _, c in found)), strict=True):
        out[i] = chr(ord(c) - int(c) + int(d))
    return "".join(out)


def _email(text: str, tweak: str) -> str:
    local, _, domain = text.partition("@")
    labels = domain.split(".")
    return shuffled(local, f"{tweak}/{domain.lower()}") + "@" + ".".join([shuffled(".".join(labels[:-1]), f"{tweak}/domain"), labels[-1]])


def _phone(text: str, tweak: str) -> str:
    def f(d: str) -> str:
        keep = max(0, len(d) - 10)  # a country code
        return d[:keep] + shuffled(d[keep:], f"{tweak}/phone")

    return _digits(text, f)


def _ipv4(text: str, tweak: str) -> str:
    def kind(x: int) -> tuple:
        a, b = x >> 24, x >> 16 & 255
        return (a in (0, 10, 127) or a >= 224 or (a, b) in ((192, 168), (169, 254)) or a == 172 and 16 <= b < 32, a if a in (0, 10, 127) else (a, b) if (a, b) in ((192, 168), (169, 254)) else a >= 224, a == 172 and 16 <= b < 32)

    x = int.from_bytes(bytes(map(int, text.split("."))))
    low = {10: 24, 127: 24}.get(x >> 24, 16 if kind(x)[0] and x >> 24 < 224 and x >> 24 else 32)
    base = x >> low << low
    y = x
    while (y := base + moved(y - base, 1 << low, f"{tweak}/{low}")) != x and kind(y) != kind(x):
        pass
    return ".".join(map(str, y.to_bytes(4)))


def _card(text: str, tweak: str) -> str:
    def f(d: str) -> str:
        body = d[0] + shuffled(d[1:-1], f"{tweak}/card") + "0"
        return body[:-1] + str((_luhn(d) - _luhn(body)) % 10)

    return _digits(text, f)


def _ssn(text: str, tweak: str) -> str:
    return _digits(text, lambda d: shuffled(d, f"{tweak}/ssn"))


def _iban(text: str, tweak: str) -> str:
    plain = text.replace(" ", "")
    body = shuffled(plain[4:], f"{tweak}/iban/{plain[:2]}")
    made = plain[:2] + f"{98 - _iban_rest(plain[:2] + '00' + body):02d}" + body
    chars = iter(made)
    return "".join(c if c == " " else next(chars) for c in text)


def _given(name: str, tweak: str) -> str | None:
    if name not in _GIVEN:
        return None
    script, gender, i = _GIVEN[name]
    names = GIVEN[script, gender]
    return names[moved(i, len(names), f"{tweak}/given/{script}/{gender}")]


def _family(name: str, tweak: str) -> str:
    """A Cyrillic surname keeps the ending that shows its gender; both forms of one surname get both forms of one surrogate."""
    if name[0] in "dl" and name[1:2] in ("'", "’"):  # d'Artagnan
        return name[:2] + _family(name[2:], tweak)
    end = re.search(r"(?:ов|ев|ёв|ин|ск)(?:а|ая|ий|ой)?$", name)
    stem = name[: end.start()] if end and end.start() > 1 else name
    return shuffled(stem, f"{tweak}/family/{end[0][:2] if end and stem != name else ''}") + name[len(stem) :]


def _unlisted(name: str, tweak: str) -> str:
    """A given name that isn't on the lists keeps an ending that tells the gender in many languages."""
    end = name[-1] if len(name) > 2 and name[-1] in "aoаяα" else ""
    stem = name[: len(name) - len(end)]
    return shuffled(stem, f"{tweak}/unlisted/{end}") + end


def _parts(found: re.Match) -> tuple[list[str], int]:
    """The words of a name, and the place of the first that is part of the family name."""
    words = (found["names"] or f"{found['given']} {found['family']}").split(" ")
    names = [i for i, w in enumerate(words) if w not in PARTICLES]
    return words, 0 if len(names) < 2 else names[0] + 1


def _first(name: str, tweak: str) -> str:
    """A given name, each part of one with hyphens on its own."""
    return "-".join(_given(x, tweak) or _unlisted(x, tweak) for x in name.split("-"))


def _person(found: re.Match, tweak: str) -> str:
    words, family = _parts(found)
    made = [w if w in PARTICLES else _first(w, tweak) if i < family else _family(w, tweak) for i, w in enumerate(words)]
    return found[0][: len(found[0]) - len(" ".join(words))] + " ".join(made)


def _valid_card(text: str) -> bool:
    d = re.sub(r"\D", "", text)
    return 13 <= len(d) <= 19 and (_luhn(d) == 0 or len(d) == 16)


#: Kind, expression, whether a match counts, surrogate, and the normal form that says which mentions are of one entity.
Rule = tuple[str, re.Pattern, Callable[[str], bool], Callable[[re.Match, str], str], Callable[[re.Match], str]]
RULES: Sequence[Rule] = (
    ("email", EMAIL, lambda t: True, lambda m, k: _email(m[0], k), lambda m: m[0].lower()),
    ("iban", IBAN, lambda t: _iban_rest(t.replace(" ", "")) == 1, lambda m, k: _iban(m[0], k), lambda m: m[0].replace(" ", "")),
    ("card", CARD, _valid_card, lambda m, k: _card(m[0], k), lambda m: re.sub(r"\D", "", m[0])),
    ("ipv4", IPV4, lambda t: True, lambda m, k: _ipv4(m[0], k), lambda m: m[0]),
    ("ssn", SSN, lambda t: True, lambda m, k: _ssn(m[0], k), lambda m: re.sub(r"\D", "", m[0])),
    ("phone", PHONE, lambda t: 7 <= sum(map(str.isdecimal, t)) <= 15, lambda m, k: _phone(m[0], k), lambda m: "".join(str(int(c)) for c in m[0] if c.isdecimal())),
    ("person", PERSON, lambda t: True, lambda m, k: _person(m, k), lambda m: m["names"] or f"{m['given']} {m['family']}"),
    ("person", _MENTION, lambda t: True, lambda m, k: _family(m[0], k), lambda m: m[0]),
)
ANNOUNCED, MENTIONED = len(RULES) - 2, len(RULES) - 1
_NO_DIGITS = bytes(b for b in range(256) if not 48 <= b <= 57)
_NAMED = re.compile("|".join(sorted({"M.", *_TITLE_GENDER, *_GIVEN} - {"M"}, key=len, reverse=True)))


def detect(text: str, raw: bytes) -> list[tuple[int, int, int, re.Match]]:
    """(start, -end, number of the rule, match), sorted; where some overlap, the first and longest stays.

    A rule runs only over texts that hold what it needs: an at sign, enough digits, a title or a known given name. The family
    names of the persons that were announced are then looked for in the whole text, so that a mention without a title is replaced
    like one with it.
    """
    digits = len(raw.translate(None, _NO_DIGITS)) >= 4 or not text.isascii() and any(map(str.isdecimal, text))
    found = []
    for i, (kind, pattern, valid, _, _) in enumerate(RULES[:MENTIONED]):
        needs = b"@" in raw if kind == "email" else _NAMED.search(text) is not None if kind == "person" else digits
        if needs:
            found += [(m.start(), -m.end(), i, m) for m in pattern.finditer(text) if valid(m[0])]
    found = _apart(found)
    families = {w for _, _, i, m in found if i == ANNOUNCED for words, first in [_parts(m)] for w in words[first:] if w not in PARTICLES}
    if families:
        found = _apart(found + [(m.start(), -m.end(), MENTIONED, m) for m in _MENTION.finditer(text) if m[0] in families])
    return found


def _apart(found: list[tuple[int, int, int, re.Match]]) -> list[tuple[int, int, int, re.Match]]:
    """Those that overlap none before them."""
    out, free = [], 0
    for start, end, i, m in sorted(found, key=lambda x: x[:3]):
        if start >= free:
            out.append((start, end, i, m))
            free = -end
    return out


def _hash(kind: str, value: str, tweak: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{tweak}/hash/{kind}/{value}".encode("utf-8", "replace"), digest_size=8).digest(), signed=True)


def replaced(text: str, raw: bytes, tweak: str) -> tuple[str, list[dict]]:
    """The text with its entities replaced, and the entities: places in the text made, and keyed hashes of both normal forms."""
    out, entities, at, size = [], [], 0, 0
    for start, end, i, m in detect(text, raw):
        kind, pattern, _, make, normal = RULES[i]
        made = make(m, tweak)
        again = pattern.fullmatch(made)
        size += start - at
        out += [text[at:start], made]
        entities.append({"kind": kind, "start": size, "end": size + len(made), "original": _hash(kind, normal(m), tweak), "surrogate": _hash(kind, normal(again) if again else made, tweak)})
        size, at = size + len(made), -end
    return "".join([*out, text[at:]]), entities


def collisions(made: DataFrame) -> DataFrame:
    """Surrogates (kind, surrogate) that more than one entity of the corpus has got, or that are the entity itself."""
    pairs = made.select(F.inline("entities")).select("kind", "original", "surrogate").distinct()
    return pairs.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("original") == F.col("surrogate")).cast("int")).alias("same")).where("n > 1 or same = 1")


def secret_tweak(key: bytes, attempt: int = 0) -> str:
    """What all permutations and hashes of one attempt are keyed with; it doesn't give the key away."""
    if not key:
        raise ValueError("surrogates need a key")
    return hashlib.blake2b(f"v{attempt}".encode(), key=hashlib.blake2b(key).digest(), digest_size=32).hexdigest()


def pseudonymize(docs: DataFrame, key: bytes) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, text with surrogates, entities.

    Who knows the key can undo the surrogates; equal keys give equal surrogates in every run, so that corpora can be joined.
    A null text stays null and has no entities; empty texts and texts without entities stay as they are. Texts are read
    whole. Repeated rows keep their rows and get the same surrogates; a null doc_id is carried along. Other columns are
    ignored, whatever their names; an empty table gives none.
    """
    for attempt in range(16):
        tweak = secret_tweak(key, attempt)

        def run(batches: Iterator[pa.RecordBatch], tweak: str = tweak) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("original", pa.int64()), ("surrogate", pa.int64())]))
            for b in batches:
                column = b.column(1)
                made = [replaced(t, raw, tweak) if t is not None else (None, []) for t, raw in zip(column.to_pylist(), payloads(column), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in made], pa.string()), pa.array([e for _, e in made], kind)], ["doc_id", "text", "entities"])

        out = materialize(arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, f"doc_id long, text string, entities {ENTITY}"), "pseudonymized")
        if collisions(out).isEmpty():
            return out
    raise RuntimeError("surrogates collide under every tweak of the key")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pseudonymize() over documents with the key of the session's setting, else with the one for synthetic tables."""
    made = pseudonymize(documents(spark, sf_dir), spark.conf.get(KEY_SETTING, EXAMPLE_KEY).encode())
    count = lambda kind: F.size(F.filter("entities", lambda e: e["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["start"], e["end"])), ",")
    return made.select("doc_id", F.size("entities").cast("long").alias("n_entities"), *(count(r[0]) for r in RULES[:MENTIONED]), spans.alias("spans"), "text")
