"""Secret scans in DataFrame functions alone.

Base spans are those of three patterns. The method adds candidate strings (runs of one character class) that have a window of
high Shannon entropy: a window slides over the string; of the sum of n log2 n over its characters' counts only the terms of the
leaving and the entering character are changed. What an allow-list knows as harmless is taken out of a candidate first; what is left
to both sides of it is judged for itself.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_text


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: group whose length counts, and the least length
    group: int
    least: int
    #: what a text with a match of this kind contains, cheap to look for: one of these strings, and a match of this
    strings: tuple[str, ...]
    hint: str


#: In the order in which spans of one start are listed. Fixed values of the contract.
BASE = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, (":", "="), r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 16, ("AKIA",), "AKIA[A-Z0-9]{12}"),
    Kind("hex", r"[0-9a-f]{32,}", 0, 32, (), r"[0-9a-f]{32}"),  # runs of 32 and more, the longest that there are
)


@dataclass(frozen=True)
class EntropyClass:
    name: str
    pattern: str
    window: int
    #: bits for each character that a window needs
    bits: float
    #: what the string must contain besides
    needs: tuple[str, ...]
    hint: str


#: Random digits of base 16 reach about 3.3 bits in 24 characters, those of base 32 and 36 about 4, those of base 64 about 4.2; words of one case stay near 3.4.
CLASSES = (
    EntropyClass("entropy_hex", r"(?<![0-9A-Za-z])[0-9A-Fa-f]{24,}(?![0-9A-Za-z])", 24, 3.0, ("[0-9]", "[A-Fa-f]"), r"[0-9A-Fa-f]{24}"),
    EntropyClass("entropy_base64", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_-])", 24, 3.9, ("[0-9]", "[A-Z]", "[a-z]"), r"[A-Za-z0-9+/_-]{24}"),
    EntropyClass("entropy_one_case", r"(?<![0-9A-Za-z])(?:[0-9a-z]{24,}|[0-9A-Z]{24,})(?![0-9A-Za-z])", 24, 3.55, ("[0-9]", "[A-Za-z]"), r"[0-9a-z]{24}|[0-9A-Z]{24}"),
)
#: A run as long as any of the classes and the hex kind need, in the characters that they are all made of; most texts have none. Runs are tried once, from their start.
LONG_RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24}+"
#: Strings of high entropy that are no secrets: alphabets and counting rows, placeholders, paths and file names.
ALLOWED = r"(?i)abcdefgh|bcdefghi|01234567|12345678|qwertyui|example|placeholder|changeme|x{6}|0{8}|f{8}|/(?:usr|home|var|etc|static|assets|images|wp-content)/"


#: Matches and characters that are folded at a time: what a fold appends to stays short.
PART = 256


def _given(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _parts(items: Column, size: int = PART) -> Column:
    """An array cut into arrays of ``size`` items."""
    firsts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(size)))
    return F.transform(F.coalesce(firsts, F.array().cast("array<int>")), lambda i: F.slice(items, i, F.lit(size)))


def _matches(text: Column, pattern: str, group: int) -> Column:
    """array<struct<start, end, found, size>> of the matches of a pattern, left to right, in code points.

    What lies between the matches comes from split, what they are from regexp_extract_all, so each starts where the
    lengths before it add up to. They are added up in parts, so that the time is in proportion to the number of matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(found), F.lit(1)))
    zipped = F.arrays_zip(between.alias("gap"), found.alias("found"))
    spans = "array<struct<start:int,end:int,found:string,size:int>>"
    sized = lambda m: F.length(F.regexp_extract(m["found"], pattern, group) if group else m["found"])

    def step(acc: Column, m: Column) -> Column:
        a = acc["at"] + F.length(m["gap"])
        b = a + F.coalesce(F.length(m["found"]), F.lit(0))
        return F.struct(b.alias("at"), F.concat(acc["spans"], F.array(F.struct(a.alias("start"), b.alias("end"), m["found"].alias("found"), sized(m).alias("size")))).alias("spans"))

    def part(acc: Column, ms: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), F.array().cast(spans).alias("spans"))
        return _given(F.aggregate(ms, start, step), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["parts"], F.array(x["spans"])).alias("parts")))

    return _given(zipped, lambda z: F.aggregate(_parts(z), F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{spans}>").alias("parts")), part, lambda acc: F.flatten(acc["parts"])))


_NO_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _spans(text: Column, rank: int, name: str, pattern: str, group: int, least: int, hint: Column, more=None) -> Column:
    kept = F.filter(_matches(text, pattern, group), lambda m: (m["size"] >= least) & (more(m["found"]) if more else F.lit(True)))
    spans = F.transform(kept, lambda m: F.struct(m["start"], F.lit(rank).alias("rank"), m["end"], F.lit(name).alias("kind")))
    return F.when(hint, spans).otherwise(F.array().cast(_NO_SPANS)).cast(_NO_SPANS)


#: Where each character's count is kept in ``counts``; one position more is for all other characters.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="


def has_random_window(text: Column, window: int, bits: float) -> Column:
    """Whether some ``window`` (at most 90) characters in a row have an entropy of ``bits`` or more; false for shorter strings.

    One fold over the characters carries the window's characters, their counts and S, the sum of n log2 n over the counts: entropy is
    log2(w) - S / w. An entering and a leaving character change one count and one term each. The counts are a string with a character
    for each of the alphabet, "!" and n characters further for a count of n. Characters are read in parts, so that time grows
    with the length and memory stays bounded.
    """
    most = window * (math.log2(window) - bits) + 1e-9  # the largest S that is random enough
    # by count (and one), what one more adds to S
    rise = F.array(*(F.lit((n + 1) * math.log2(n + 1) - (n * math.log2(n) if n else 0.0)) for n in range(window + 1)))
    place = lambda c: F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), c), F.lit(0)), F.lit(len(ALPHABET) + 1))
    code = lambda counts, at: F.ascii(F.substring(counts, at, F.lit(1)))
    put = lambda counts, at, code: F.overlay(counts, F.char(code), at, F.lit(1))

    def step(acc: Column, c: Column) -> Column:
        """A character enters and, if the window is full, its first one leaves; as long as it is not, nothing is judged."""
        full = F.length(acc["held"]) >= window
        gone = F.substring(acc["held"], F.lit(1), F.lit(1))
        without = F.when(full, _given(place(gone), lambda at: _given(code(acc["counts"], at), lambda n: F.struct(put(acc["counts"], at, n - 1).alias("counts"), (acc["s"] - F.get(rise, n - 34)).alias("s")))))
        without = F.coalesce(without, F.struct(acc["counts"].alias("counts"), acc["s"].alias("s")))

        def entered(x: Column) -> Column:
            held = F.concat(F.when(full, F.substring(acc["held"], F.lit(2), F.lit(window))).otherwise(acc["held"]), c)
            return _given(place(c), lambda at: _given(code(x["counts"], at), lambda n: F.struct(held.alias("held"), put(x["counts"], at, n + 1).alias("counts"), (x["s"] + F.get(rise, n - 33)).alias("s"))))

        judged = lambda x: F.struct(x["held"].alias("held"), x["counts"].alias("counts"), x["s"].alias("s"), ((F.length(x["held"]) >= window) & (x["s"] <= most)).alias("found"))
        same = full & (gone == c)  # one of it leaves and one enters
        turned = F.struct(F.concat(F.substring(acc["held"], F.lit(2), F.lit(window)), c).alias("held"), acc["counts"].alias("counts"), acc["s"].alias("s"), acc["found"].alias("found"))
        return F.when(acc["found"], acc).when(same, turned).otherwise(_given(_given(without, entered), judged))

    start = F.struct(F.lit("").alias("held"), F.lit("!" * (len(ALPHABET) + 1)).alias("counts"), F.lit(0.0).alias("s"), F.lit(False).alias("found"))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
    piece = lambda acc, p: F.when(acc["found"], acc).otherwise(F.aggregate(F.split(p, ""), acc, step))
    return (F.length(text) >= window) & F.aggregate(pieces, start, piece, lambda acc: acc["found"])


def _random(c: EntropyClass):
    def test(part: Column) -> Column:
        ok = F.length(part) >= c.window
        for need in c.needs:
            ok = ok & part.rlike(need)
        return ok & has_random_window(part, c.window, c.bits)

    return lambda found: F.exists(F.split(found, ALLOWED, -1), test)


def scan(docs: DataFrame) -> DataFrame:
    """``row``, a struct with the columns of ``docs``, ``text``, and ``base`` and ``spans``: arrays of (start, rank, end, kind), sorted.

    Starts and ends are in code points, ends exclusive. A null text is scanned as empty, a text of any length as a whole, in time that grows
    with it. Spans of different kinds may overlap. Spans of one start are listed by kind. Repeated rows come back as often as they occur,
    columns of any name stay inside ``row``, and an empty table gives an empty result.
    """
    x = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("long", F.col("text").rlike(LONG_RUN))
    text, long = F.col("text"), F.col("long")

    def hint(k: Kind | EntropyClass) -> Column:
        cheap = reduce(lambda a, b: a | b, (text.contains(s) for s in k.strings)) if isinstance(k, Kind) and k.strings else long
        return cheap & text.rlike(k.hint)

    base = F.concat(*(_spans(text, i, k.name, k.pattern, k.group, k.least, hint(k)) for i, k in enumerate(BASE)))
    added = F.concat(*(_spans(text, len(BASE) + i, c.name, c.pattern, 0, c.window, hint(c), _random(c)) for i, c in enumerate(CLASSES)))
    return x.withColumn("base", F.array_sort(base)).withColumn("spans", F.array_sort(F.concat("base", added))).drop("long")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id``, the numbers of base spans by kind, the hash of their list, and all spans, for each row of ``docs``."""
    found = scan(docs.select("doc_id", "text"))
    n = [F.size(F.filter("base", _is(k.name))).cast("long").alias(f"n_{k.name}") for k in BASE]
    return found.select("row.doc_id", *n, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by ``[kind]``, overlapping ones by that of the first; ``n_chars`` follows where there is such a column.

    A null text stays null and a text without spans as it is; rows and columns are otherwise those of ``docs``. Texts are read in parts of ``PART``
    characters, so that what lies between two spans is found without reading the text from its start again.
    """
    kept = "array<struct<from:int,start:int,kind:string>>"

    def step(acc: Column, s: Column) -> Column:
        new = F.struct(acc["at"].alias("from"), s["start"].alias("start"), s["kind"].alias("kind"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["kept"], F.array(new))).otherwise(acc["kept"]).alias("kept"))

    def part(acc: Column, some: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), F.array().cast(kept).alias("kept"))
        return _given(F.aggregate(some, start, step), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["parts"], F.array(x["kept"])).alias("parts")))

    def between(pieces: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / PART).cast("int")
        whole = F.array_join(F.slice(pieces, first + 1, F.floor((b - 1) / PART).cast("int") - first + 1), "")
        return F.when(b > a, F.substring(whole, a % PART + 1, b - a)).otherwise("")

    def cut(pieces: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kept}>").alias("parts"))

        def put_together(x: Column) -> Column:
            each = F.transform(F.flatten(x["parts"]), lambda k: F.concat(between(pieces, k["from"], k["start"]), F.lit("["), k["kind"], F.lit("]")))
            return F.concat(F.array_join(each, ""), between(pieces, x["at"], F.length("text")))

        return _given(F.aggregate(_parts(F.col("spans")), start, part), put_together)

    pieces = F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
    found = scan(docs).withColumn("cut", F.when(F.size("spans") > 0, _given(pieces, cut)))
    return with_text(found, docs, F.col("cut").isNotNull(), F.col("cut"))
