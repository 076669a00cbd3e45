"""Personal data replaced by keyed surrogates.

Mentions of personal data are found by patterns. What a mention names (its letters and
digits, whatever the punctuation) is an entity. All entities of the corpus are a table;
each is given a surrogate drawn from a keyed hash, of the same kind: digits for digits,
letters for letters, valid numbers for valid numbers, a name of the same script and gender
for a name. A name that a title shows once is looked for in the rest of its text, too: Dr
Maria Garcia, Mrs Garcia, Maria Garcia and Garcia are one entity there. Entities whose surrogates collide, or whose surrogate is an entity itself, draw
again, round by round, until all differ; late rounds draw longer surrogates, so that there
are enough however many entities there are. Then the same entity has the same surrogate
everywhere, and different ones have different surrogates. The surrogate takes the format
of each mention: its case, its separators.

Only documents with mentions, and of them only ids, entities and texts, are shuffled.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.session import materialize

ROUNDS = 40
# Rounds after which surrogates are longer by one more syllable, letter or digit; the first
# GROW rounds twice, so that most keep the entity's format.
GROW = 4

_TITLES = {
    "m": "Mr Mister Sir Herr Monsieur Señor Sr Don Signor господин".split(),
    "f": "Mrs Ms Miss Madam Lady Frau Fräulein Madame Mme Mademoiselle Señora Sra Señorita Srta Doña Signora госпожа".split(),
    "n": "Dr Prof Professor Doktor Docteur Doctor".split(),
}
_GENDER = {t.lower(): g for g, titles in _TITLES.items() for t in titles}
# Parts of invented names, per script and gender.
_GIVEN = {
    ("latin", "m"): "Alden Boris Caleb Darius Edgar Felix Gideon Hugo Ivo Jonas Kilian Lukas Milo Nestor Otis Pavel".split(),
    ("latin", "f"): "Alma Bianca Clara Daria Edith Flora Greta Hanna Irma Jana Klara Livia Mira Nora Olga Petra".split(),
    ("latin", "n"): "Alexis Robin Dominique Kim Sascha Toni Jessie Marion Noa Luca Andrea Jules Charlie Remy Ariel Sky".split(),
    ("cyrillic", "m"): "Антон Борис Вадим Глеб Денис Егор Захар Игорь Кирилл Лев Макар Никита Олег Павел Роман Семён".split(),
    ("cyrillic", "f"): "Алла Белла Вера Галина Дарья Ева Зоя Инна Кира Лидия Майя Нина Ольга Полина Рита Софья".split(),
    ("cyrillic", "n"): "Саша Женя Валя Слава Шура Паша Тоня Валера".split(),
}
_SYLLABLES = {
    "latin": "bar cor dal fen gor hal kem lor mar nel por ren sel tor ven wil".split(),
    "cyrillic": "бар вол гор дан зар кам лен мор нес пол ров сел тар фед хар чер".split(),
}
_ENDINGS = {
    ("latin", "m"): ["son", "man"], ("latin", "f"): ["son", "man"], ("latin", "n"): ["son", "man"],
    ("cyrillic", "m"): ["ов", "ин"], ("cyrillic", "f"): ["ова", "ина"], ("cyrillic", "n"): ["енко", "ко"],
}

# Titles as they are written, and all in capitals.
_titles = [form for titles in _TITLES.values() for t in titles for form in (t, t.upper())]
_title = "|".join(sorted(map(re.escape, _titles), key=len, reverse=True))
# A part of a name, an initial, and small words within names.
_part = r"[^\W\d_a-zа-я][^\W\d_]+"
_small = "von der|von dem|van der|van den|de la|de los|von|van|der|den|de|del|della|di|da|du|la|le|bin|ibn|al"
_name = rf"(?:[^\W\d_a-zа-я]\. ?)*{_part}(?:[ -](?:(?:{_small}) )?{_part}){{0,4}}"
_octet = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
# In this order; an earlier kind wins where two overlap. The group is what is replaced.
PATTERNS = {
    "email": re.compile(r"(?<![\w.+%-])([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"),
    "ip": re.compile(rf"(?<![\w.])({_octet}(?:\.{_octet}){{3}})(?!\.?\w)"),
    "ipv6": re.compile(r"(?<![\w:.])([0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7})(?![\w:]|\.\d)"),
    "key": re.compile(r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,})(?![A-Za-z0-9])"),
    "secret": re.compile(
        r"(?i)(?<![A-Za-z])(?:password|passwd|passphrase|pwd|token|secret|api[_-]?key|access[_-]?key)"
        r"[\"']?[ ]?[=:][ ]?[\"']?([^\s\"',;]{6,})"
    ),
    "iban": re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"),
    "ssn": re.compile(r"(?<![\w-])(\d{3}-\d{2}-\d{4})(?![\w-])"),
    "phone": re.compile(
        r"(?<![\w+])((?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]?\d{3,4}|\+\d{8,15}"
        r"|\+\d{1,3}(?:[ .-]\(?\d{1,4}\)?){3,6}|0\d(?:[ .-]\d{2}){4}|\(\d{2,4}\) ?\d{2,4}(?:[ .-]\d{2,4}){1,3})(?!\w)"
    ),
    "card": re.compile(r"(?<![\w.])(\d(?:[ -]?\d){12,18})(?![\w])"),
    "name": re.compile(rf"(?<!\w)(?:(?:{_title})\.? )({_name})"),
}
_secret_words = "pass", "pwd", "token", "secret", "key"
# Without one of these there is no ip, iban, ssn, phone or card number.
_digits = re.compile(r"\d{3}|\d\.\d|[A-Z]\d\d|\d\d[ .-]\d\d")
_colons = re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f]{0,4}:|::[0-9A-Fa-f]")


def _possible(text: str) -> list[str]:
    """The kinds that the text may hold, by what none of them can do without."""
    kinds = []
    if "@" in text:
        kinds.append("email")
    digits = _digits.search(text) is not None
    if digits:
        kinds.append("ip")
    if ":" in text and _colons.search(text):
        kinds.append("ipv6")
    if "AKIA" in text or "ASIA" in text or "sk-" in text or ("gh" in text and "_" in text):
        kinds.append("key")
    if "=" in text or ":" in text:
        low = text.lower()
        if any(w in low for w in _secret_words):
            kinds.append("secret")
    if digits:
        kinds += ["iban", "ssn", "phone", "card"]
    if any(t in text for t in _titles):
        kinds.append("name")
    return kinds


class Mention(NamedTuple):
    """``gender`` is that of a name's title, empty for other kinds."""

    start: int
    stop: int
    kind: str
    entity: str
    gender: str


def _essence(kind: str, found: str) -> str:
    """What all formats of an entity have in common."""
    if kind in ("ssn", "phone", "card"):
        return re.sub(r"\D", "", found)
    if kind in ("email",):
        return found.lower()
    if kind == "iban":
        return found.replace(" ", "")
    if kind == "name":
        return " ".join(re.split(r"[ -]", found)).casefold()
    if kind == "ipv6":
        return ipaddress.ip_address(found).exploded
    return found


def _masked(secret: str) -> bool:
    """Whether somebody has already put one and the same sign in place of each character."""
    return len(set(secret)) == 1 and not secret[0].isalnum()


def _script(name: str) -> str:
    return "cyrillic" if unicodedata.name(name[0], "").startswith("CYRILLIC") else "latin"


def _spelt(found: str) -> list[str]:
    """The parts of a name that are written out: no initials and no small words."""
    words = re.split(r"[ -]", re.sub(r"(?:^|(?<=[ .]))\w\. ?", "", found))
    return [w for w in words if w and w[0].isupper()]


def _address(found: str) -> bool:
    # Names like a::b are addresses, too, but hardly ever meant so.
    if not any(len(part) > 2 and any(map(str.isdigit, found)) for part in found.split(":")):
        return False
    try:
        ipaddress.IPv6Address(found)
    except ValueError:
        return False
    return True


def _free(found: list[Mention], start: int, stop: int) -> bool:
    return not any(start < x.stop and x.start < stop for x in found)


def mentions(text: str | None) -> list[Mention]:
    """Where personal data stands, in order, without overlaps.

    A name's entity is its script and its parts without initials. Where a name of several
    parts was found, its last part alone, and its parts together, are mentions of it in the
    rest of the text too, with or without a title: kinds family and name.
    """
    found: list[Mention] = []
    titled: list[tuple[re.Match, list[str]]] = []
    for kind in _possible(text) if text else ():
        for m in PATTERNS[kind].finditer(text):
            start, stop = m.span(1)
            if kind == "secret" and _masked(m[1]):
                continue
            if kind == "ipv6" and not _address(m[1]):
                continue
            if not _free(found, start, stop):
                continue
            if kind == "name":
                if parts := _spelt(m[1]):
                    titled.append((m, parts))
                continue
            found.append(Mention(start, stop, kind, _essence(kind, m[1]), ""))
    families: dict[str, str] = {}
    whole: dict[str, str] = {}
    for m, parts in titled:
        if len(parts) > 1:
            entity = f"{_script(parts[0])} {_essence('name', ' '.join(parts))}"
            families.setdefault(parts[-1].casefold(), entity)
            whole.setdefault(" ".join(parts), entity)
    for m, parts in titled:
        start, stop = m.span(1)
        # The place of the parts within what was matched: initials before them go, too.
        entity, kind = f"{_script(parts[0])} {_essence('name', ' '.join(parts))}", "name"
        if len(parts) == 1 and parts[0].casefold() in families:
            entity, kind = families[parts[0].casefold()], "family"
        title = re.split(r"[. ]", m[0])[0].lower()
        if _free(found, start, stop):
            found.append(Mention(start, stop, kind, entity, _GENDER[title]))
    for said, entity, kind in [
        *((name, e, "name") for name, e in whole.items()),
        *((name.rsplit(" ", 1)[1], e, "family") for name, e in whole.items()),
    ]:
        if len(said) > 2:
            for m in re.finditer(rf"(?<![\w@.]){re.escape(said)}(?![\w@])", text):
                if _free(found, *m.span()):
                    found.append(Mention(*m.span(), kind, entity, "n"))
    return sorted(found)


def _luhn(digits: list[int]) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


class _Draw:
    """Numbers from a keyed hash of (kind, entity, round)."""

    def __init__(self, key: bytes, kind: str, entity: str, round_: int):
        self.made = f"{kind}\0{entity}\0{round_}".encode(), key
        self.left, self.count = 0, 0

    def below(self, n: int) -> int:
        if self.left < 2**32:
            told, key = self.made
            more = hmac.new(key, told + self.count.to_bytes(4, "big"), hashlib.sha256).digest()
            self.left, self.count = int.from_bytes(more, "big"), self.count + 1
        self.left, value = divmod(self.left, n)
        return value


def surrogate(key: bytes, kind: str, entity: str, round_: int) -> str:
    """The essence of the entity's surrogate in this round."""
    draw = _Draw(key, kind, entity, round_)
    more = max(0, round_ // GROW - 1)
    if kind == "name":
        script, gender, name = entity.split(" ", 2)
        given, ending = _GIVEN[script, gender], _ENDINGS[script, gender]
        family = "".join(_SYLLABLES[script][draw.below(16)] for _ in range(3 + more)) + ending[draw.below(2)]
        parts = name.count(" ") + 1
        first = [given[draw.below(len(given))] for _ in range(parts - 1)]
        return f"{script} {gender} " + " ".join([*first, family]).casefold()
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "ipv6":  # the prefix for documentation
        return ":".join(["2001", "0db8", *(f"{draw.below(65536):04x}" for _ in range(6))])
    symbols = kind == "secret" and not any(map(str.isalnum, entity))
    keep = 4 if kind == "key" else 2 if kind == "iban" else 0
    out = []
    for i, c in enumerate(entity):
        if i < keep:
            out.append(c)
        elif c.isnumeric():
            out.append(str(draw.below(10)))
        elif c.isalpha() or symbols:
            if kind == "secret" and re.fullmatch(r"[0-9a-f]+", entity):
                out.append("abcdef"[draw.below(6)])
            else:
                out.append(chr((65 if c.isupper() else 97) + draw.below(26)))
        else:
            out.append(c)
    if kind == "email":  # the last label of the host says what kind of host it is
        host = entity.rsplit(".", 1)[1]
        out[len(out) - len(host) :] = host
    extra = [draw.below(10 if kind in ("ssn", "phone", "card") else 26) for _ in range(more)]
    if kind == "phone" and len(out) >= 10:
        out[: len(out) - 10] = entity[: len(out) - 10]  # the country
        out[-10] = str(2 + draw.below(8))
    if kind in ("ssn", "phone", "card"):
        out += map(str, extra)
    elif kind == "email":  # the host stays as long as it was
        out = [chr(97 + x) for x in extra] + out
    else:
        out += [chr((65 if kind == "iban" else 97) + x) for x in extra]
    if kind == "card":
        out[0] = str(int(entity[0]))
        if _luhn([int(c) for c in entity]):
            digits = [int(c) for c in out]
            out[-1] = next(str(d) for d in range(10) if _luhn([*digits[:-1], d]))
    return "".join(out)


def render(kind: str, found: str, essence: str) -> str:
    """The surrogate in the format of the mention ``found``."""
    if kind in ("name", "family"):
        words = essence.split(" ")[2:]
        if kind == "family":
            words = words[-1:]
        # Initials and small words are left out, a hyphen between two parts stays.
        gaps = re.findall(r"(?<=\w)[ -](?=[^\W\d_a-zа-я])", re.sub(r"(?:^|(?<=[ .]))\w\. ?", "", found))
        gaps = (["-"] if "-" in gaps else [" "]) * (len(words) - 1) if len(gaps) < len(words) - 1 else gaps
        shown = [w.upper() if found.isupper() and len(found) > 2 else w.capitalize() for w in words]
        return shown[0] + "".join(g + w for g, w in zip(gaps, shown[1:]))
    if kind == "ipv6":
        made = ipaddress.ip_address(essence)
        made = made.exploded if len(found) == 39 else made.compressed
        return made.upper() if found.isupper() else made
    if kind == "email":
        more = len(essence) - len(found)
        same = "".join(e.upper() if c.isupper() else e for c, e in zip(found, essence[more:], strict=True))
        return essence[:more] + same
    if kind in ("ssn", "phone", "card"):
        digits = iter(essence)
        return "".join(next(digits) if c.isdigit() else c for c in found) + "".join(digits)
    if kind == "iban":
        rest = iter(essence)
        return "".join(c if c == " " else next(rest) for c in found) + "".join(rest)
    return essence


def _with_mentions(some: bool, row: str = "", told: str = ""):
    """Rows with mentions, and where these are, or rows without."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            found = [mentions(t) for t in batch["text"].to_pylist()]
            keep = [i for i, x in enumerate(found) if bool(x) == some]
            part = batch.take(pa.array(keep, pa.int64()))
            if some:
                rows = pa.array([at + i for i in keep], pa.int64())
                kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("entity", pa.string()), ("gender", pa.string())]))
                part = pa.RecordBatch.from_arrays(
                    [rows, pa.array([[m._asdict() for m in found[i]] for i in keep], kind), *part.columns],
                    [row, told, *part.schema.names],
                )
            at += batch.num_rows
            yield part

    return find


def _drawn(key: bytes):
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [surrogate(key, *x) for x in zip(*(batch[c].to_pylist() for c in ("kind", "entity", "round")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, "drawn"])

    return draw


def distinct_surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, drawn): a different surrogate for each of the distinct ``entities``.

    A surrogate that is one of the entities, or that a smaller entity drew as well, is
    drawn again, from GROW rounds to GROW rounds with one more syllable, letter or digit.
    Only addresses (ip) cannot grow: it raises if ROUNDS do not suffice for them, which
    takes about as many as half of all that there can be.
    """
    schema = "kind string, entity string, round int, drawn string"
    settled, todo = None, entities.withColumn("round", F.lit(0))
    for round_ in range(ROUNDS):
        made = materialize(todo.mapInArrow(_drawn(key), schema))
        taken = entities.select("kind", F.col("entity").alias("drawn"))
        if settled is not None:
            taken = taken.union(settled.select("kind", "drawn"))
        free = made.join(taken.distinct(), ["kind", "drawn"], "left_anti")
        first = free.groupBy("kind", "drawn").agg(F.min("entity").alias("entity"))
        first = materialize(first.select("kind", "entity", "drawn"))
        settled = first if settled is None else settled.union(first)
        todo = made.join(first, ["kind", "entity"], "left_anti").select("kind", "entity", F.lit(round_ + 1).alias("round"))
        todo = materialize(todo)
        if todo.isEmpty():
            return settled
    raise ValueError("too few surrogates for the entities of a kind")


def _replace(names: list[str], own: list[str]):
    told, given_, n = own

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, found, given in zip(*(batch[c].to_pylist() for c in ("text", told, given_)), strict=True):
                drawn = {(g["kind"], g["entity"]): g["drawn"] for g in given}
                out, at = [], 0
                for m in found:
                    said = text[m["start"] : m["stop"]]
                    kind = "name" if m["kind"] == "family" else m["kind"]
                    out += [text[at : m["start"]], render(m["kind"], said, drawn[kind, m["entity"]])]
                    at = m["stop"]
                texts.append("".join([*out, text[at:]]))
            columns = [pa.array(texts, pa.string()) if c == "text" else batch[c] for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(map(len, batch[told].to_pylist()), pa.int64())], [*names, n])

    return replace


def _unused(names: list[str], wanted: list[str]) -> list[str]:
    """Column names like those wanted that none of ``names`` is, whatever their case."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


def _with_gender(named: DataFrame) -> DataFrame:
    """(kind, entity, drawn_for): a name's entity with the one gender that its titles have, or n."""
    known = F.array_sort(F.collect_set(F.when(F.col("gender").isin("m", "f"), F.col("gender"))))
    settled = named.groupBy("kind", "entity").agg(known.alias("genders"))
    gender = F.when(F.size("genders") == 1, F.col("genders")[0]).otherwise("n")
    script, name = F.substring_index("entity", " ", 1), F.expr("substring(entity, length(substring_index(entity, ' ', 1)) + 2)")
    full = F.concat_ws(" ", script, gender, name)
    return settled.select("kind", "entity", F.when(F.col("kind") == "name", full).otherwise(F.col("entity")).alias("drawn_for"))


def pseudonymize(docs: DataFrame, key: str, count: str | None = None) -> DataFrame:
    """``docs`` with personal data in the column text replaced; other columns as they are.

    ``key`` is the secret: the same key gives the same surrogates for the same corpus. With
    ``count`` a column of that name has the number of mentions. Null and empty texts have no
    mentions; repeated rows stay; an empty table gives no rows; a very long text is one
    row's work. A secret masked already (one sign repeated, ********) is none. A name needs a
    title before it (Mr, FRAU, Señora ...) somewhere in the text, and is then found without
    one too, whole or by its last part. A name has one surrogate under all titles: of the
    titles' gender, or of neither if they have none or both.
    """
    names = docs.columns
    row, told, given_, n = _unused(names, ["row", "mentions", "given", "n"])
    schema = T.StructType([*docs.schema.fields])
    with_mentions = T.StructType(
        [
            T.StructField(row, T.LongType()),
            T.StructField(told, T._parse_datatype_string("array<struct<start:int,stop:int,kind:string,entity:string,gender:string>>")),
            *schema.fields,
        ]
    )
    without = docs.mapInArrow(_with_mentions(False), schema).withColumn(n, F.lit(0).cast("long"))
    having = materialize(docs.mapInArrow(_with_mentions(True, row, told), with_mentions))
    kind = F.when(F.col("m.kind") == "family", "name").otherwise(F.col("m.kind")).alias("kind")
    named = having.select(F.col(row).alias("row"), F.explode(told).alias("m"))
    named = named.select("row", kind, "m.entity", "m.gender").distinct()
    settled = materialize(_with_gender(named))
    entities = materialize(settled.select("kind", F.col("drawn_for").alias("entity")).distinct())
    drawn = distinct_surrogates(entities, key.encode()).withColumnRenamed("entity", "drawn_for")
    given = (
        named.select("row", "kind", "entity").distinct()
        .join(settled.join(drawn, ["kind", "drawn_for"]), ["kind", "entity"])
        .groupBy(F.col("row").alias(row))
        .agg(F.collect_list(F.struct("kind", "entity", "drawn")).alias(given_))
    )
    replaced = having.join(given, row).mapInArrow(
        _replace(names, [told, given_, n]), T.StructType([*schema.fields, T.StructField(n, T.LongType())])
    )
    both = without.union(replaced)
    return both.select(*names, F.col(n).alias(count)) if count else both.select(*names)
