"""Lines that repeat an earlier line of the corpus, exactly or within a few edits.

Two lines within ``edits`` edits share a segment: cut the shorter one into ``edits + 1`` segments, and one
of them stands unchanged in the longer one, shifted by no more than the edits before and after it allow. Each
distinct line is indexed by its segments and probes with the substrings that could be a segment of a
line of its length or up to ``edits`` shorter. Lines that meet are verified by banded edit distance. Everything
is made of built-in column functions.

A line goes by one earlier line, so of many lines that share a segment only the earliest meet all that look for it.
Other lines under such a segment are told apart by what is left of them without it, which is within the edits
again and so shares a segment of its own, and so on; the shortest rests are compared by their forms with a gap
for each edit. Lines that meet grow with the lines of a group, not with its square, and no link is lost.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F, Window

from tickloom.llm.tables import OWN, may_hold
from tickloom.session import written_once

EDITS = 2
#: Shorter lines are not compared within edits.
MIN_CHARS = 32

#: Frequent letters, whose counts tell most lines apart; the result does not depend on them.
LETTERS = "eaintor"
#: Bits of their counts; up to 7 edits fit above them.
BITS = 4 * len(LETTERS)

LAST = (1 << 63) - 1

#: Lines under one segment that meet all that look for it, the earliest; with further ones, they are cut again.
WITNESSES = 32
#: So many times as many meet where lines are cut again, since their ``pair_bits`` are compared there, too.
MORE_WITNESSES = 8
#: Rests of lines below this length are not cut again.
SHORT = 6
#: What stands in a rest for a segment, and in a form for an edit; no line holds a line break.
CUT, GAP = "\n", "\n\n"


def _segment(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """Start from 0 and size of segment ``i`` of a line; the last ones are one longer at most."""
    parts = edits + 1
    extra = length % parts
    base = ((length - extra) / parts).cast("int")
    plain = F.lit(parts) - extra
    start = base * i + F.greatest(F.lit(i) - plain, F.lit(0))
    return start, base + F.when(F.lit(i) >= plain, 1).otherwise(0)


def _shifts(i: int, shorter: int, edits: int) -> range:
    """How far segment ``i`` can stand from its place in a line that is so much longer."""
    return range(max(-i, shorter - (edits - i)), min(i, shorter + edits - i) + 1)


def _key(i: int, length: Column, text: Column) -> Column:
    return F.xxhash64(F.lit(i), length, text)


def index_keys(line: Column, length: Column, edits: int) -> Column:
    """A key for each segment of a line: its number, the line's length and its text."""
    places = [_segment(length, i, edits) for i in range(edits + 1)]
    return F.array(*[
        _key(i, length, F.substring(line, start + 1, size))
        for i, (start, size) in enumerate(places)])


def probe_keys(line: Column, length: Column, edits: int) -> Column:
    """The keys under which lines within ``edits`` edits, no longer than this one, are indexed.

    With each goes how much shorter the indexed line is. For each length and segment, only the shifts that leave enough edits on both sides.
    """
    keys = []
    for shorter in range(edits + 1):
        other = length - shorter
        for i in range(edits + 1):
            start, size = _segment(other, i, edits)
            for shift in _shifts(i, shorter, edits):
                key = _key(i, other, F.substring(line, start + shift + 1, size))
                keys.append(F.struct(key.alias("of"), F.lit(shorter).alias("shorter")))
    return F.array(*keys)


def letter_counts(line: Column) -> Column:
    """How often each of ``LETTERS`` occurs, modulo 16, in four bits each."""
    size = F.octet_length(line)
    counts = [size - F.octet_length(F.replace(line, F.lit(c), F.lit(""))) for c in LETTERS]
    packed = [F.shiftleft(n.bitwiseAND(15), 4 * k) for k, n in enumerate(counts)]
    return functools.reduce(Column.bitwiseOR, packed)


def counts_apart(one: Column, two: Column) -> Column:
    """The sum of the differences of letter counts: an edit makes up 2 at most, and 1 if it changes
    the length."""
    apart = []
    for k in range(len(LETTERS)):
        step = F.abs(F.shiftright(one, 4 * k).bitwiseAND(15) - F.shiftright(two, 4 * k).bitwiseAND(15))
        apart.append(F.least(step, 16 - step))
    return sum(apart)


def pair_bits(line: Column) -> Column:
    """Of which of 64 kinds of two neighbouring characters a line holds an odd number."""
    chars = F.split(line, "")
    kinds = F.zip_with(chars, F.slice(chars, 2, F.size(chars)),
                       lambda c, d: F.pmod(F.xxhash64(c, d), F.lit(64)).cast("int"))
    return F.aggregate(kinds, F.lit(0).cast("bigint"), lambda bits, k: bits.bitwiseXOR(
        F.call_function("shiftleft", F.lit(1).cast("bigint"), k)))


def all_near(one: dict[str, Column], two: dict[str, Column], edits: int, by: Column) -> Column:
    """Whether two lines, one ``by`` longer, can be within the edits by their letters and pairs of neighbours.

    An edit makes up four such pairs at most, and three if it changes the length.
    """
    return (counts_apart(one["letters"], two["letters"]) <= 2 * edits - by) & (
        F.bit_count(one["bits"].bitwiseXOR(two["bits"])) <= 4 * edits - by)


def _spread(rows: DataFrame, by: str) -> DataFrame:
    """Few rows with much work each, over all partitions."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


def near_pairs(distinct: DataFrame, edits: int, witnesses: int = WITNESSES) -> DataFrame:
    """Pairs of names (``a``, ``b``) of lines that share a segment; a is the smaller name.

    Lines that share one but whose letters differ by more than the edits allow do not become pairs. Of
    two lines of one length, either finds the other, and one of these is enough. Of the lines under a key only the
    earliest ``witnesses`` become pairs. Where there are more, the key comes as ``b``, marked ``open``, with each
    line that looks for it as ``a``.
    """
    line, length = F.col("line"), F.col("chars")
    index = distinct.select(
        "name", "letters", "first", F.explode(index_keys(line, length, edits)).alias("key"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("first"))
    early = index.withColumn("rank", rank).where(F.col("rank") <= witnesses + 1)
    probe = distinct.select(
        F.col("name").alias("other"), "letters", F.explode(probe_keys(line, length, edits)).alias("k")
    ).select("other", "k.of", F.shiftleft("k.shorter", BITS).bitwiseOR(F.col("letters")).alias("packed"))
    shorter = F.shiftright("packed", BITS)
    apart = counts_apart(F.col("letters"), F.col("packed"))
    once = (F.col("name") < F.col("other")) | ((shorter > 0) & (F.col("name") != F.col("other")))
    more = F.col("rank") > witnesses
    met = early.join(
        probe, (F.col("key") == F.col("of")) & (more | (once & (apart <= 2 * edits - shorter))))
    return met.select(
        F.when(more, F.col("other")).otherwise(F.least("name", "other")).alias("a"),
        F.when(more, F.col("key")).otherwise(F.greatest("name", "other")).alias("b"),
        more.alias("open")).distinct()


def cut_again(rows: DataFrame, edits: int) -> DataFrame:
    """For each segment of each row's ``rest`` its ``key``, and as ``rest`` what is left, with a mark in its place.

    Rows that ``probes`` are ``by`` longer than those they look for.
    """
    rest = F.col("rest")
    length = F.length(rest) - F.when(F.col("probes"), F.col("by")).otherwise(0)

    def without(i: int, shift: int) -> Column:
        start, size = _segment(length, i, edits)
        return F.struct(
            _key(i, length, F.substring(rest, start + shift + 1, size)).alias("key"),
            F.concat(F.substring(rest, F.lit(1), start + shift), F.lit(CUT),
                     F.substring(rest, start + shift + size + 1, F.length(rest))).alias("rest"))

    parts = F.when(~F.col("probes"), F.array(*[without(i, 0) for i in range(edits + 1)]))
    for by in range(edits + 1):
        parts = parts.when(F.col("by") == by, F.array(*[
            without(i, shift) for i in range(edits + 1) for shift in _shifts(i, by, edits)]))
    kept = [c for c in rows.columns if c != "rest"]
    return rows.withColumn("part", F.explode(parts)).select(*kept, "part.key", "part.rest")


def forms(rest: Column, edits: int) -> Column:
    """A rest with a gap for each edit, in place of a character or between two, in all ways.

    Two rests are within the edits, segment marks aligned, just if they have a form in common.
    """
    def with_gap(one: Column) -> Column:
        size, gap = F.size(one), F.array(F.lit(GAP))
        between = F.transform(F.sequence(F.lit(0), size), lambda i: F.concat(
            F.slice(one, F.lit(1), i), gap, F.slice(one, i + 1, size)))
        taken = F.filter(F.sequence(F.lit(1), size), lambda i: F.get(one, i - 1) != CUT)
        return F.concat(between, F.transform(taken, lambda i: F.concat(
            F.slice(one, F.lit(1), i - 1), gap, F.slice(one, i + 1, size))))

    found = F.array(F.transform(
        F.sequence(F.lit(1), F.length(rest)), lambda i: F.substring(rest, i, F.lit(1))))
    for _ in range(edits):
        found = F.array_distinct(F.flatten(F.transform(found, with_gap)))
    return found


def later_of(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """``name, check`` of the later line of each pair of names (``a``, ``b``) within the edits."""
    one = texts.select(*[F.col(c).alias(f"{c}_a") for c in texts.columns])
    two = texts.select(*[F.col(c).alias(f"{c}_b") for c in texts.columns])
    near = _spread(pairs, "a").join(one, F.col("a") == F.col("name_a")).join(
        two, (F.col("b") == F.col("name_b"))
        & all_near(*[{c: F.col(f"{c}_{side}") for c in ("letters", "bits")} for side in "ab"], edits, F.lit(0))).where(
        F.levenshtein("line_a", "line_b", edits) >= 0)
    a_first = F.struct("first_a", "line_a") < F.struct("first_b", "line_b")
    later = {c: F.when(a_first, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a"))
             for c in ("name", "check")}
    return near.select(*[v.alias(c) for c, v in later.items()]).distinct()


def gone_under(
    keys: DataFrame, names: DataFrame, texts: DataFrame, gone: DataFrame, edits: int, witnesses: int
) -> DataFrame:
    """``name, check`` of lines that go, by lines under the same of the ``keys`` or known before to be ``gone``.

    Step by step, the earliest of those that are looked for in a bucket meet all that look for them. Buckets
    with more of these and with lines that are not known to go are cut again.
    """
    own = texts.join(names, "name", "left_semi").select(
        "name", "first", "letters", "bits", F.lit(0).alias("by"), F.lit(False).alias("probes"), F.col("line").alias("rest"))
    every = F.array(*[F.lit(d) for d in range(edits + 1)])
    probes = own.withColumn("by", F.explode(every)).withColumn("probes", F.lit(True))
    cut = cut_again(own.unionByName(probes), edits).join(keys, "key", "left_semi")
    rows = cut.withColumn("by", F.explode(F.when(F.col("probes"), F.array("by")).otherwise(every))).withColumn(
        "bucket", F.xxhash64("key", "by")).drop("key")
    long = F.length("rest") - F.when(F.col("probes"), F.col("by")).otherwise(0) >= SHORT
    while True:
        rows = written_once(rows.distinct())
        if rows.isEmpty():
            return gone
        rank = F.row_number().over(Window.partitionBy("bucket", "probes").orderBy("first"))
        early = rows.where(long).withColumn("rank", rank).where(F.col("rank") <= witnesses).select(
            F.col("bucket").alias("of"), F.col("probes").alias("probing"), F.col("name").alias("a"),
            F.col("first").alias("before"), F.col("letters").alias("letters_a"), F.col("bits").alias("bits_a"))
        left = rows.join(gone.select("name"), "name", "left_anti").where((F.col("by") > 0) | F.col("probes"))
        pairs = early.join(
            _spread(left, "bucket"), (F.col("of") == F.col("bucket")) & (F.col("probing") != F.col("probes"))
            & (F.col("a") != F.col("name")) & (F.col("before") <= F.col("first"))
            & all_near({c: F.col(f"{c}_a") for c in ("letters", "bits")},
                       {c: F.col(c) for c in ("letters", "bits")}, edits, F.col("by"))
        ).select("a", F.col("name").alias("b")).distinct()
        formed = rows.where(~long).join(texts.select("name", "line"), "name").select(
            "name", F.struct("first", "line", "name").alias("place"),
            F.explode(F.transform(forms(F.col("rest"), edits), lambda f: F.xxhash64("bucket", f))).alias("form"))
        earliest = formed.groupBy("form").agg(F.min("place")["name"].alias("a"))
        short = formed.select("form", F.col("name").alias("b")).join(earliest, "form").where(
            "a != b").select("a", "b").distinct()
        gone = written_once(gone.unionByName(
            later_of(pairs.unionByName(short).distinct(), texts, edits)).distinct())
        known = rows.where(long).join(gone.select("name", F.lit(True).alias("goes")), "name", "left")
        looked, stays = F.col("probes"), F.col("goes").isNull()
        wanting = known.groupBy("bucket").agg(
            F.count_if(~looked).alias("own"), F.count_if(looked).alias("probing"),
            F.count_if(~looked & stays).alias("own_left"), F.count_if(looked & stays).alias("probing_left"),
            F.max("by").alias("by")).where(
            ((F.col("own") > witnesses) & (F.col("probing_left") > 0))
            | ((F.col("by") > 0) & (F.col("probing") > witnesses) & (F.col("own_left") > 0)))
        # Where neither side is longer, lines that go are not looked for as probes.
        more = known.where(~looked | stays | (F.col("by") > 0)).drop("goes").join(
            wanting.select("bucket"), "bucket", "left_semi")
        rows = cut_again(more, edits).withColumn("bucket", F.xxhash64("bucket", "key")).drop("key")


def repeated_lines(
    lines: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, witnesses: int = WITNESSES
) -> DataFrame:
    """Of the lines (``line``, ``doc``), those held more than once or close to an earlier one.

    Lines under ``min_chars`` characters are only counted, not compared.

    Returns ``name, check`` (two hashes of the line), ``first`` (the first document with it) and ``goes``:
    whether an earlier distinct line lies within the edits. A distinct line is earlier by its first
    document, then by its text.
    """
    name, check = F.xxhash64("line"), F.xxhash64(F.lit(1), F.col("line"))
    distinct = lines.groupBy("line").agg(
        F.min("doc").alias("first"), F.count(F.lit(1)).alias("n"))
    # All uses below need all columns, so that they share one exchange of the lines' text.
    distinct = distinct.where((F.col("first") <= LAST) & (F.col("n") > 0)).withColumns({
        "chars": F.length("line"), "letters": letter_counts(F.col("line")), "name": name, "check": check})
    # The count keeps this from being asked of the lines before the exchange, which would make a second one.
    met = near_pairs(distinct.where(F.when(F.col("n") > 0, F.col("chars")) >= min_chars), edits, witnesses)
    copies = distinct.where("n > 1").select(
        F.col("name").alias("a"), F.col("check").alias("b"), F.lit(None).cast("boolean").alias("open"), "first")
    found = written_once(met.withColumn("first", F.lit(None).cast("bigint")).unionByName(copies))
    pairs, opened = found.where("NOT open").select("a", "b"), found.where("open")
    sides = pairs.select(F.explode(F.array("a", "b")).alias("name")).unionByName(
        opened.select(F.col("a").alias("name")))
    # Only lines that have met others are gathered once more.
    named = lines.where(F.length("line") >= min_chars).withColumn("name", name)
    texts = written_once(may_hold(sides, named, "name").groupBy("line").agg(F.min("doc").alias("first")).select(
        name.alias("name"), check.alias("check"), "line", "first",
        letter_counts(F.col("line")).alias("letters"), pair_bits(F.col("line")).alias("bits")))
    gone = written_once(later_of(pairs, texts, edits))
    if not opened.isEmpty():
        gone = gone_under(opened.select(F.col("b").alias("key")).distinct(),
                          opened.select(F.col("a").alias("name")).distinct(), texts, gone, edits, MORE_WITNESSES * witnesses)
    goes = gone.select("name", "check", F.lit(LAST).alias("first"), F.lit(True).alias("goes"))
    copied = found.where("open IS NULL").select(
        F.col("a").alias("name"), F.col("b").alias("check"), "first", F.lit(False).alias("goes"))
    return copied.unionByName(goes).groupBy("name", "check").agg(
        F.min("first").alias("first"), F.max("goes").alias("goes"))


def removed_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS,
    min_chars: int = MIN_CHARS, short_copies: bool = False, witnesses: int = WITNESSES,
) -> DataFrame:
    """The documents' rows that lose lines: their row number and the lines' places from 0, sorted."""
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("doc"),
        F.col(text_col).cast("string").alias("text"))
    all_lines = numbered.select(
        "row", "doc", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    taking = F.col("line").rlike(r"\S") if short_copies else F.length("line") >= min_chars
    taken = all_lines.where(taking)
    known = repeated_lines(taken.select("line", "doc"), edits, min_chars, witnesses)
    # A line that a document repeats itself stays where it stands first.
    names = taken.select("row", "doc", "place", F.xxhash64("line").alias("name"),
                         F.xxhash64(F.lit(1), F.col("line")).alias("check"))
    met = names.join(known, ["name", "check"])
    own_first = met.groupBy("row", "name", "check").agg(
        F.min("place").alias("stays"), F.collect_list("place").alias("places"),
        F.max(F.col("goes") | (F.col("doc") != F.col("first"))).alias("all"))
    going = own_first.select("row", F.explode(F.when(F.col("all"), F.col("places")).otherwise(
        F.filter("places", lambda p: p != F.col("stays")))).alias("place"))
    return going.groupBy("row").agg(F.sort_array(F.collect_list("place")).alias("places"))


def remaining(text: Column, removed: Column) -> Column:
    """A text without the lines at the places in ``removed``."""
    lines = F.transform(F.split(text, "\n"), lambda line, i: F.when(
        ~F.array_contains(removed, i), line))
    kept = F.array_join(F.filter(lines, lambda line: line.isNotNull()), "\n")
    return F.when(F.size(removed) == 0, text).otherwise(kept)


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS,
    min_chars: int = MIN_CHARS, out: str = "__lines", short_copies: bool = False, witnesses: int = WITNESSES,
) -> DataFrame:
    """Adds struct ``out`` to each document: ``n_lines`` and the places ``removed``, from 0 and sorted.

    A line of at least ``min_chars`` characters goes if an earlier line of the corpus is within ``edits``
    edits of it, and every copy of a line goes but the first one in the document with the smallest id
    (null ids last; rows that share an id count as one document there). With ``short_copies``, copies of
    shorter lines go alike unless these are blank, of whitespace alone; else shorter lines stay.
    ``remaining`` gives the text of the other lines. A null text has no lines; an empty text has one empty line. Repeated rows are
    treated alike, and no rows give no rows. All input columns are kept, whatever their names, but for one
    named as ``out``. Of more than ``witnesses`` lines that share a segment, the earliest are compared first; the
    result does not depend on their number. The rows must come in the same order whenever they are read, as those of files do.
    """
    row, count, places = f"{OWN}row", f"{OWN}count", f"{OWN}places"
    text = F.col(text_col).cast("string")
    # Counted before the join, so that it moves no texts unless they are wanted.
    numbered = docs.withColumns({
        row: F.monotonically_increasing_id(), count: F.coalesce(F.size(F.split(text, "\n")), F.lit(0))})
    going = removed_lines(docs, id_col, text_col, edits, min_chars, short_copies, witnesses).select(
        F.col("row").alias(f"{OWN}at"), F.col("places").alias(places))
    return numbered.join(going, F.col(row) == F.col(f"{OWN}at"), "left").withColumn(out, F.struct(
        F.col(count).alias("n_lines"),
        F.coalesce(F.col(places), F.array().cast("array<int>")).alias("removed"))).drop(
        row, count, f"{OWN}at", places)
