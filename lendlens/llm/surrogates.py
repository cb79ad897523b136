"""Surrogates for personal data.

E-mail addresses, telephone, card, account and social security numbers, IP addresses and names
after an honorific are found in every text and replaced. A surrogate is drawn from an HMAC of
type and canonical value, so every mention of an entity, in any text and any writing of it,
gets the same one, in the writing of the mention: digits for digits, letters of the same script
and case for letters, given names of the same gender, valid octets, a right check digit where
there was one. Names are whole words of any cased script, up to the last part; given and family
names are drawn separately, so a family name has one surrogate with every title. What was found
after an honorific is also replaced where it stands bare in the same text. Particles (von, de) and
suffixes (Jr) stay.

Surrogates are checked over all texts: one that equals another entity's surrogate, or a real
value that occurs, is drawn anew for all but the first entity, until none is left. Only the
numbers of draws above zero are joined back to their texts.

Defined results: a NULL text stays NULL, a text without entities stays as it is. Overlapping
mentions are taken in the order of `KINDS`, then leftmost. Equal texts get equal results, one
row per row.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.llm.scratch import written

KEY = b"surrogate"
#: Draws after which a surrogate may be longer, as the shape may have no free value.
WIDER_AFTER = 8

def _upper() -> str:
    """The capital letters of all scripts, as the inside of a character class."""
    capitals = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Lu", "Lt")]
    runs: list[list[int]] = []
    for c in capitals:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in runs)


_CAPITAL = f"[{_upper()}]"
_LETTER = r"(?:[^\W\d_]|[\u0300-\u036f])"
#: A possessive s is not part of a name.
_PART = rf"{_CAPITAL}(?:{_LETTER}|['’-](?!s(?!\w))(?={_LETTER}))*(?!\w)"
_INITIAL = rf"{_CAPITAL}\.(?:[ -]?{_CAPITAL}\.)*"
_PARTICLE = r"(?:von|vom|van|de|der|den|del|della|di|da|do|dos|du|la|le|ten|ter|zu|zur|bin|ibn|al|el)"
_NAME = rf"(?:{_PARTICLE}[ \xa0])*(?:{_INITIAL}|{_PART})"
_SUFFIXES = frozenset(["Jr", "Sr", "II", "III", "IV"])
_PIECES = re.compile(rf"(?P<initial>{_INITIAL})|(?<!\w)(?P<part>{_PART})")
MALE = ("Mr", "Herr", "Monsieur", "M.", "Señor", "Sr.", "Sr", "Don", "Господин")
FEMALE = (
    "Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra.", "Sra",
    "Señorita", "Doña", "Госпожа",
)
NEUTRAL = ("Dr.", "Dr", "Prof.", "Prof")
_HONORIFIC = "|".join(re.escape(h) for h in sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))
#: Kinds of entities, first come first served.
KINDS = {
    "email": r"[\w.+%-]+@(?:[\w-]+\.)+[A-Za-z]{2,}",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ipv4": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)",
    "ipv6": r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<!\w)\d(?:[ -]?\d){12,18}(?!\w)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)"
    r"|(?<![\w+])\+\d{1,3}(?:[ .-]\(?\d{1,4}\)?){2,5}(?!\w)"
    r"|(?<![\w+])\+\d{7,14}(?!\w)",
    "name": rf"(?<!\w)(?P<title>{_HONORIFIC})(?:\.[ \xa0]?|[ \xa0])(?:(?:Dr|Prof)(?:\.[ \xa0]?|[ \xa0]))*"
    rf"(?P<name>{_NAME}(?:[ \xa0]?(?<=[ \xa0.]){_NAME})*)",
}
_FOUND = {kind: re.compile(pattern) for kind, pattern in KINDS.items()}
#: Fewest digits of a telephone number.
PHONE_DIGITS = 7
#: A country code that is set apart from the number; it stays as it is.
_COUNTRY = re.compile(r"^\+\d{1,3}[ .-]")
#: What a text must hold to be searched for a kind.
_NEEDS = {"email": "@", "ipv6": ":", "ssn": "-"}
_DIGIT = re.compile(r"\d")
_TAKEN = "\0"
#: Marks what belongs to the mention before.
MORE = "+"

#: Given names by gender and script; family names are made of syllables.
GIVEN = {
    ("m", "latin"): "Adam Boris Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Oscar".split(),
    ("f", "latin"): "Anna Berta Clara Diana Elena Flora Greta Helena Irene Julia Karla Laura Maria Olga".split(),
    ("n", "latin"): "Alex Andrea Chris Dominique Kim Luca Noa Robin Sascha Toni".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Иван Максим Олег Павел Роман".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Ирина Мария Нина Ольга София".split(),
    ("n", "cyrillic"): "Женя Саша Валя Слава".split(),
    ("m", "greek"): "Ανδρέας Βασίλης Γιώργος Δημήτρης Κώστας Νίκος Πέτρος Σταύρος".split(),
    ("f", "greek"): "Άννα Βάσω Δήμητρα Ελένη Κατερίνα Μαρία Σοφία Χριστίνα".split(),
    ("n", "greek"): "Αλέξ Ρένα Φανή".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de di do fa fe ga ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta to va vo".split(),
    "greek": "βα βε βο δα δε κα κο λα λε μα με να νε ρα ρο σα σο τα το".split(),
    "cyrillic": "ба бе бо да де ди до ка ко ла ле ло ма ме мо на не но ра ро са се со та то ва во".split(),
}


def gender(honorific: str) -> str:
    title = honorific.strip()
    for sex, titles in (("m", MALE), ("f", FEMALE)):
        if any(title.rstrip(".") == t.rstrip(".") for t in titles):
            return sex
    return "n"


def script(name: str) -> str:
    if re.search("[\u0370-\u03ff\u1f00-\u1fff]", name):
        return "greek"
    return "cyrillic" if re.search("[\u0400-\u052f]", name) else "latin"


def mentions(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, canonical value, detail) of every entity, in order.

    Parts of a name are entities of their own; all but a mention's first have the detail `MORE`.
    """
    found: list[tuple[int, int, str, str, str]] = []
    some_digit = _DIGIT.search(text) is not None
    for kind, pattern in _FOUND.items():
        if _NEEDS.get(kind, "") not in text or kind not in ("email", "name") and not some_digit:
            continue
        spans = []
        for match in pattern.finditer(text):
            if kind == "name":
                for part in _name_parts(match):
                    spans.append(part[:2])
                    found.append(part)
                continue
            start, end = match.span()
            value = text[start:end]
            detail = ""
            if kind == "phone" and len(re.sub(r"\D", "", value)) < PHONE_DIGITS:
                continue
            spans.append((start, end))
            found.append((start, end, kind, canonical(kind, value, detail), detail))
        if spans:
            # Later kinds do not see what is taken.
            edges = [0, *(edge for span in spans for edge in span), len(text)]
            text = "".join(
                text[a:b] if i % 2 == 0 else _TAKEN * (b - a)
                for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
            )
    return sorted([*found, *_bare(text, found)])


def _name_parts(match: re.Match) -> list[tuple[int, int, str, str, str]]:
    """Given names, initials and the family name, the last part that is no suffix."""
    sex, whole, at = gender(match["title"]), match["name"], match.start("name")
    pieces = [p for p in _PIECES.finditer(whole) if p[0] not in _SUFFIXES] or list(_PIECES.finditer(whole))
    parts = []
    for i, piece in enumerate(pieces):
        kind = "initial" if piece["initial"] else "name"
        detail = f"g{sex}" if i < len(pieces) - 1 else "n"
        value = canonical(kind, piece[0], detail + script(piece[0]))
        parts.append((at + piece.start(), at + piece.end(), kind, value, MORE if i else ""))
    return parts


def _bare(text: str, found: list[tuple[int, int, str, str, str]]) -> list[tuple[int, int, str, str, str]]:
    """Repeats, without an honorific, of the names found; `text` has these taken out."""
    values: dict[str, str] = {}
    for _, _, kind, value, _ in sorted(found):
        if kind == "name":
            name = value.partition(":")[2]
            if name not in values or value.startswith("n"):
                values[name] = value
    if not values:
        return []
    any_name = "|".join(map(re.escape, sorted(values, key=len, reverse=True)))
    repeats, at = [], -1
    for match in re.finditer(rf"(?<!\w)(?:{any_name})(?!\w)", text):
        detail = MORE if match.start() == at + 1 and text[at] in " \xa0" else ""
        repeats.append((*match.span(), "name", values[match[0]], detail))
        at = match.end()
    return repeats


def canonical(kind: str, value: str, detail: str = "") -> str:
    """What all writings of an entity have in common."""
    if kind == "phone":
        value = _COUNTRY.sub("", value)
    if kind in ("card", "phone", "ssn"):
        return re.sub(r"\D", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "name":
        return f"{detail}:{value}"
    if kind == "initial":
        return value
    return value.lower()


class _Draw:
    """Numbers from an HMAC in counter mode."""

    def __init__(self, key: bytes, kind: str, value: str, draw: int):
        self.key, self.name, self.block, self.left = key, f"{kind}\0{value}\0{draw}".encode(), 0, b""

    def __call__(self, below: int) -> int:
        if len(self.left) < 8:
            counted = self.name + b"\0" + str(self.block).encode()
            self.left += hmac.new(self.key, counted, hashlib.sha256).digest()
            self.block += 1
        number, self.left = int.from_bytes(self.left[:8], "big"), self.left[8:]
        return number % below


def _luhn(digits: str) -> int:
    """The sum that is divisible by ten if the last digit checks the others."""
    doubled = (int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits)))
    return sum(d - 9 if d > 9 else d for d in doubled)


def _digits(value: str, draw: _Draw) -> str:
    """As many digits; the first is zero only if it was."""
    made = "".join(str(draw(10)) for _ in value)
    if value[0] != "0" and made[0] == "0":
        made = str(1 + draw(9)) + made[1:]
    return made


def _letter(c: str, draw: _Draw) -> str:
    if c.isdigit():
        return str(draw(10))
    if not c.isalpha():
        return c
    if script(c) == "greek":
        made = "αβγδεζηθικλμνξοπρστυφχψω"[draw(24)]
        return made.upper() if c.isupper() else made
    alphabet = "абвгдежзиклмнопрстуфхцчшэюя" if script(c) == "cyrillic" else "abcdefghijklmnopqrstuvwxyz"
    made = alphabet[draw(len(alphabet))]
    return made.upper() if c.isupper() else made


def surrogate(kind: str, value: str, draw_number: int = 0, key: bytes = KEY) -> str:
    """The canonical surrogate of a canonical value."""
    draw = _Draw(key, kind, value, draw_number)
    wider = max(0, draw_number - WIDER_AFTER + 1)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        labels = domain.split(".")
        shown = [x if x == "example" else "".join(_letter(c, draw) for c in x) for x in labels[:-1]]
        extra = "".join(_letter("a", draw) for _ in range(wider))
        local = "".join(_letter(c, draw) for c in local)
        return f"{local}{extra}@{'.'.join([*shown, labels[-1]])}"
    if kind == "ipv4":
        low = {1: 1, 2: 10, 3: 100}
        octets = value.split(".")
        sizes = [len(o) if not wider else 3 for o in octets]
        return ".".join(str(low[n] + draw({1: 9, 2: 90, 3: 155}[n])) for n in sizes)
    if kind == "ipv6":
        return ":".join("".join("0123456789abcdef"[draw(16)] for _ in p) for p in value.split(":"))
    if kind == "iban":
        tail = "".join(_letter(c, draw) for c in value[4:] + "0" * wider)
        return value[:2] + _digits(value[2:4], draw) + tail
    if kind == "name":
        detail, _, name = value.partition(":")
        if " " in name:
            *first, last = name.split()
            made = [surrogate(kind, f"g{detail}:{x}", draw_number, key) for x in first]
            made.append(surrogate(kind, f"n{detail[1:]}:{last}", draw_number, key))
            return f"{detail}:{' '.join(m.partition(':')[2] for m in made)}"
        kind_of = detail[2:] if detail[0] == "g" else detail[1:]
        syllables = SYLLABLES[kind_of]
        # Given names are few: one that is drawn anew gets syllables.
        count = (2 + draw(2) if detail[0] != "g" else 2 * (draw_number > 0)) + wider
        made = "".join(syllables[draw(len(syllables))] for _ in range(count))
        if detail[0] == "g":
            given = [x for x in GIVEN[detail[1], kind_of] if x != name]
            return f"{detail}:{given[draw(len(given))]}{made}"
        return f"{detail}:{made.capitalize()}"
    if kind == "initial":
        return "".join(_letter(c, draw) for c in value)
    made = _digits(value + "0" * wider, draw)
    if kind == "card" and _luhn(value) % 10 == 0:
        made = next(made[:-1] + d for d in "0123456789" if _luhn(made[:-1] + d) % 10 == 0)
    return made


def written_like(kind: str, mention: str, made: str) -> str:
    """A canonical surrogate in the writing of a mention."""
    if kind == "name":
        return made.partition(":")[2]
    if kind in ("card", "phone", "ssn", "iban"):
        code = _COUNTRY.match(mention) if kind == "phone" else None
        kept = code.end() if code else 0
        left = iter(made)
        shown = "".join(next(left, "") if c.isalnum() else c for c in mention[kept:])
        return mention[:kept] + shown + "".join(left)
    if mention.isupper():
        return made.upper()
    if len(mention) == len(made):
        return "".join(m.upper() if c.isupper() else m for c, m in zip(mention, made, strict=True))
    return made


ENTITY = "array<struct<kind:string,value:string>>"


def entities(text: Column) -> Column:
    """The distinct entities of a text."""

    def find(texts: pd.Series) -> pd.Series:
        return texts.map(
            lambda text: [
                {"kind": k, "value": v}
                for k, v in sorted({m[2:4] for m in mentions(text or "") if m[2] != "initial"})
            ]
        )

    return F.pandas_udf(find, ENTITY)(text)


def _drawn(key: bytes):
    def draw(kinds: pd.Series, values: pd.Series, draws: pd.Series) -> pd.Series:
        rows = zip(kinds, values, draws, strict=True)
        return pd.Series([surrogate(k, v, int(n), key) for k, v, n in rows], dtype=object)

    return F.pandas_udf(draw, "string")


def mapping(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, value, draw, made): a surrogate per entity of `found` (kind, value), all distinct."""
    drawn = _drawn(key)
    real = written(found.select("kind", "value").distinct(), "entities")
    taken = real.select("kind", _shown("value").alias("shown"), F.lit("").alias("first"))
    done, todo = None, real.withColumn("draw", F.lit(0))
    while True:
        todo = todo.withColumn("made", drawn("kind", "value", "draw"))
        todo = written(todo.withColumn("shown", _shown("made")), "drawn")
        first = todo.groupBy("kind", "shown").agg(F.min("value").alias("first"))
        # Real values and earlier surrogates come before all new ones.
        first = first.union(taken).groupBy("kind", "shown").agg(F.min("first").alias("first"))
        judged = written(todo.join(written(first, "first"), ["kind", "shown"]), "judged")
        settled = judged.filter(F.col("first") == F.col("value")).drop("first")
        done = settled if done is None else done.union(settled)
        todo = judged.filter(F.col("first") != F.col("value"))
        todo = written(todo.select("kind", "value", (F.col("draw") + 1).alias("draw")), "todo")
        if todo.isEmpty():
            return done.select("kind", "value", "draw", "made")
        taken = taken.union(settled.select("kind", "shown", F.lit("").alias("first")))


def _shown(of: str) -> Column:
    """What is written for a value or a surrogate: a name without its detail."""
    return F.when(F.col("kind") == "name", F.regexp_replace(of, "^[^:]*:", "")).otherwise(F.col(of))


def replaced(text: str, drawn: dict[tuple[str, str], int], key: bytes = KEY) -> tuple[str, int]:
    """A text with surrogates, by the draws above zero, and the number of mentions."""
    pieces, at = [], 0
    found = mentions(text)
    for start, end, kind, value, _ in found:
        made = surrogate(kind, value, drawn.get((kind, value), 0), key)
        pieces += [text[at:start], written_like(kind, text[start:end], made)]
        at = end
    return "".join([*pieces, text[at:]]), sum(detail != MORE for *_, detail in found)


def _replaced(key: bytes):
    def replace(texts: pd.Series, again: pd.Series) -> pd.DataFrame:
        rows = []
        for text, draws in zip(texts, again, strict=True):
            if text is None:
                rows.append((None, 0))
                continue
            drawn = {} if draws is None else {(d["kind"], d["value"]): d["draw"] for d in draws}
            rows.append(replaced(text, drawn, key))
        return pd.DataFrame(rows, columns=["text", "n_replaced"])

    return F.pandas_udf(replace, "text string, n_replaced long")


def anonymised(docs: DataFrame, key: bytes = KEY, text: str = "text") -> DataFrame:
    """doc_id, the text with surrogates, and the number of replaced mentions."""
    hashed = F.xxhash64(text)
    found = docs.select(hashed.alias("text_hash"), entities(F.col(text)).alias("each"))
    found = written(found.select("text_hash", F.explode("each").alias("one")), "found")
    found = found.select("text_hash", "one.kind", "one.value")
    redrawn = written(mapping(found, key).filter(F.col("draw") > 0), "redrawn")
    again = (
        found.distinct()
        .join(redrawn, ["kind", "value"])
        .groupBy("text_hash")
        .agg(F.collect_list(F.struct("kind", "value", "draw")).alias("again"))
    )
    rows = docs.select("doc_id", F.col(text).alias("text"), hashed.alias("text_hash"))
    rows = rows.join(written(again, "again"), "text_hash", "left")
    return rows.select("doc_id", _replaced(key)("text", "again").alias("made")).select(
        "doc_id", "made.text", "made.n_replaced"
    )
