"""Near-duplicate lines by a segment-partition edit join, with DataFrame functions only.

Distinct lines are cut into distance + 1 even segments. Two lines within the edit distance share a
whole segment of the shorter one, at a place of the longer one that the length difference and the
segment's number confine to a few offsets. So each line is indexed by (length, segment number,
segment) and probes, for every length from its own down to its own less the distance, the
substrings at those offsets. Candidates must also agree in ten letter counts but for twice the
distance, and of four times as many segments of the shorter line all but `distance` must stand in
the longer one, at most `distance` characters away from their own place; what they begin and end
with alike is taken off; then a banded bit-parallel edit distance is computed: the vertical differences of a band
of 2 * distance + 1 cells stand in the bits of two numbers, and each character of the longer line is
one step of additions, shifts and masks. Links are closed to classes, and the class's first
occurrence stays.

A key under which more than max_key lines are indexed is refined: the shared segment is taken out of
both lines, what is left is within the distance too, and is cut into segments and probed again,
under the old key. Keys that are still crowded after `levels` refinements are dealt in slices of the
indexed lines over tasks.

Lines shorter than min_chars are compared for equality only. Lines without a word stay. "First" is
by document id, then text hash, then position; a null id comes first. Null texts have no lines and
stay null. Rows equal in id and text are treated alike. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import components, cut, save

#: Letters whose counts a line's signature holds.
LETTERS = "etaoinshrd"
#: They are counted in so many characters from a line's start.
COUNTED = 512
#: So many ids of candidate lines are broadcast at most (8 bytes each); beyond it they are joined by a shuffle.
MOST_SENT = 500_000


def segment(i: int | Column, chars: Column, distance: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i of a line of so many chars; the longer segments come last."""
    k = distance + 1
    base, short = F.call_function("div", chars, F.lit(k)).cast("int"), k - chars % k
    return 1 + i * base + F.greatest(F.lit(0), i - short), base + (short <= i).cast("int")


def places(distance: int) -> list[tuple[int, int, int]]:
    """(length difference, segment number, offset) of every place where a segment of the shorter line may stand in the longer one."""
    return [
        (less, i, o)
        for less in range(distance + 1)
        for i in range(distance + 1)
        for o in range(max(-i, less - distance + i), min(i, less + distance - i) + 1)
    ]


def without(text: Column, at: Column, width: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + width, F.length(text)))


# One row a segment or place, then one key a row: a dozen keys in one expression would be a method that the JVM doesn't compile.


def indexed(lines: DataFrame, distance: int, rest: bool = False) -> DataFrame:
    """a, sa and key for every segment of lines (a, sa, text, n, base); with rest also text without the segment, and its length."""
    text, n, i = F.col("text"), F.col("n"), F.col("__i")
    start, width = segment(i, n, distance)
    key = F.xxhash64("base", n, i, F.substring(text, start, width)).alias("key")
    left = [without(text, start, width).alias("text"), (n - width).alias("n")] if rest else []
    return lines.withColumn("__i", F.explode(F.array(*map(F.lit, range(distance + 1))))).select("a", "sa", key, *left)


def probing(lines: DataFrame, distance: int, rest: bool = False) -> DataFrame:
    """b, sb and key for every substring that lines (b, sb, text, n, base, less) look up; with rest also text without it, its length, and less. less: the length difference where it is known, or null."""
    text, n = F.col("text"), F.col("n")
    less, i, o = (F.col("__p")[k] for k in ("less", "i", "o"))
    start, width = segment(i, n - less, distance)
    at = start + o
    key = F.xxhash64("base", n - less, i, F.substring(text, at, width)).alias("key")
    left = [without(text, at, width).alias("text"), (n - width).alias("n"), less.alias("less")] if rest else []
    asked = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("less", "i", "o"), p, strict=True))) for p in places(distance)))
    known = F.col("less").isNull() | (F.col("less") == less)
    return lines.withColumn("__p", F.explode(asked)).where((at >= 1) & (at + width - 1 <= n) & (n >= less) & known).select("b", "sb", key, *left)


def signature(line: Column, start: Column | None = None) -> Column:
    """The length modulo 16 and the counts of ten letters in the first COUNTED characters modulo 64, in one long. start: those characters, where a column holds them."""
    packed, start = (F.length(line) % 16).cast("long"), F.substring(line, 1, COUNTED) if start is None else start
    for letter in LETTERS:
        count = F.octet_length(start) - F.octet_length(F.replace(start, F.lit(letter), F.lit("")))
        packed = F.shiftleft(packed, 6).bitwiseOR(count.cast("long").bitwiseAND(F.lit(63)))
    return packed


def may_be_near(a: Column, b: Column, distance: int) -> Column:
    """Whether signatures allow the edit distance, the line of b being as long as that of a or longer.

    An edit changes the counts by two at most, taken together. This holds for first characters too: a
    replacement changes two counts, and an insertion or deletion one, and one more where it moves
    a character over the end.
    """
    ok = (F.shiftrightunsigned(b, 60) - F.shiftrightunsigned(a, 60)).bitwiseAND(F.lit(15)) <= distance
    changed = F.lit(0).cast("long")
    for g in range(len(LETTERS)):
        field = lambda c: F.shiftrightunsigned(c, 6 * g).bitwiseAND(F.lit(63))  # noqa: B023, E731
        changed += F.least((field(a) - field(b)).bitwiseAND(F.lit(63)), (field(b) - field(a)).bitwiseAND(F.lit(63)))
    return ok & (changed <= 2 * distance)


def keeps_segments(a: Column, b: Column, distance: int) -> Column:
    """Whether all but `distance` of 4 * (distance + 1) segments of a stand in b, at most `distance` characters away; true for lines within the distance, a being as long as b or shorter.

    An edit changes one segment at most, and the edits before a segment move it by one each.
    """
    parts, kept = 4 * (distance + 1), F.lit(0)
    for i in range(parts):
        start, width = segment(i, F.length(a), parts - 1)
        kept += F.contains(F.substring(b, F.greatest(F.lit(1), start - distance), width + 2 * distance), F.substring(a, start, width)).cast("int")
    return kept >= parts - distance


def without_common_start(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with columns a and b less what they begin with alike, in steps of halves from 4096 characters to 4; their edit distance stays."""
    pairs = pairs.withColumn("__at", F.lit(0))
    part = lambda c, step: F.substring(c, F.col("__at") + 1, F.lit(step))
    for step in (1 << k for k in range(12, 1, -1)):
        alike = (F.col("__at") + step <= F.length(a)) & (part(F.col(a), step) == part(F.col(b), step))
        pairs = pairs.withColumn("__at", F.col("__at") + F.when(alike, step).otherwise(0))
    rest = lambda c: F.substring(c, F.col("__at") + 1, F.length(c))
    return pairs.withColumns({a: rest(F.col(a)), b: rest(F.col(b))}).drop("__at")


def without_common_ends(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with columns a and b less what they begin and end with alike, and what is left reversed; their edit distance stays."""
    turned = without_common_start(pairs, a, b).withColumns({c: F.reverse(c) for c in (a, b)})
    return without_common_start(turned, a, b)


def let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def edit_distance(a: Column, b: Column, distance: int) -> Column:
    """The edit distance of a and b, b being as long as a or longer by `distance` at most; right up to `distance`, and above it where it is above.

    Bit o of step j stands for the cell in row j - distance + o of the column of b's j-th character.
    up and down: cells one more and one less than the cell above them. The score follows the band's
    last cell down to the last row, then that row to its end.
    """
    band = 2 * distance + 1
    mask, last = F.lit((1 << band) - 1).cast("long"), 2 * distance
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    chars = lambda s: F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))
    flip = lambda v: v.bitwiseXOR(mask)

    def run(s: Column) -> Column:
        x, y, m = s["x"], s["y"], F.size(s["x"])

        def step(state: Column, j: Column) -> Column:
            up, down, score = state["up"], state["down"], state["score"]
            equal = sum((F.when(F.get(x, j - distance + o - 1) == F.get(y, j - 1), F.lit(1 << o).cast("long")).otherwise(zero) for o in range(band)), zero)
            diagonal = lambda e: (e.bitwiseAND(up) + up).bitwiseXOR(up).bitwiseOR(e).bitwiseOR(down).bitwiseAND(mask)

            def move(v: Column) -> Column:
                right, left, same = v["right"], v["left"], F.shiftright(v["d"], 1)
                row = (m - j + distance).cast("int")  # where the last row stands in the band
                set_in = lambda w: (w.bitwiseAND(F.get(powers, row)) != 0).cast("int")
                along = set_in(right) - set_in(left)
                scored = F.when(j + distance <= m, F.lit(1) - F.shiftright(v["d"], last).bitwiseAND(one).cast("int")).otherwise(along)
                return F.struct(
                    left.bitwiseOR(flip(same.bitwiseOR(right))).bitwiseAND(mask).alias("up"),
                    same.bitwiseAND(right).alias("down"),
                    (score + scored).cast("int").alias("score"),
                )

            powers = F.array(*(F.lit(1 << o).cast("long") for o in range(band)))
            return let(let(equal, diagonal), lambda d: let(F.struct(d.alias("d"), down.bitwiseOR(flip(d.bitwiseOR(up))).alias("right"), d.bitwiseAND(up).alias("left")), move))

        first = F.struct(F.lit((1 << band) - (1 << distance)).cast("long").alias("up"), zero.alias("down"), F.least(F.lit(distance), m).alias("score"))
        return F.when(F.size(y) == 0, 0).otherwise(F.aggregate(F.sequence(F.lit(1), F.size(y)), first, step, lambda s: s["score"]))

    return let(F.struct(chars(a).alias("x"), chars(b).alias("y")), run)


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, pos and line of every line with a word."""
    text = F.col("text").cast("string")
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def candidates(lines: DataFrame, distance: int, max_key: int = 256, levels: int = 3, slice_rows: int = 8192) -> DataFrame:
    """Pairs (a, b) of ids of lines (id, line, n, sig) that share a segment and whose signatures allow the edit distance; a's line is as long or shorter."""
    ordered = (F.shiftrightunsigned("sa", 60) != F.shiftrightunsigned("sb", 60)) | (F.col("a") < F.col("b"))
    near = ordered & (F.col("a") != F.col("b")) & may_be_near(F.col("sa"), F.col("sb"), distance)
    a = lines.select(F.col("id").alias("a"), F.col("sig").alias("sa"), F.col("line").alias("text"), "n", F.lit(0).cast("long").alias("base"))
    b = lines.select(F.col("id").alias("b"), F.col("sig").alias("sb"), F.col("line").alias("text"), "n", F.lit(0).cast("long").alias("base"), F.lit(None).cast("int").alias("less"))
    found = []
    for level in range(levels + 1):
        index, probe = indexed(a, distance), probing(b, distance)
        hot = cut(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_key))
        n_hot = hot.count()
        sent = F.broadcast(hot) if n_hot <= MOST_SENT else hot
        if n_hot:
            found.append(cut(index.join(sent, "key", "left_anti").join(probe, "key").where(near).select("a", "b").distinct()))
        else:
            return cut(union_all([*found, index.join(probe, "key").where(near).select("a", "b")]).distinct())
        if level == levels:
            slices = F.ceil(F.col("n") / slice_rows).cast("int")
            dealt = index.join(sent, "key").select("a", "sa", "key", F.pmod(F.xxhash64("a"), slices).cast("int").alias("slice"))
            asked = probe.join(sent, "key").select("b", "sb", "key", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
            found.append(dealt.join(asked, ["key", "slice"]).where(near).select("a", "b"))
        else:
            a = cut(indexed(a, distance, True).join(sent, "key", "left_semi").withColumnRenamed("key", "base"))
            b = cut(probing(b, distance, True).join(sent, "key", "left_semi").withColumnRenamed("key", "base"))
    return cut(union_all(found).distinct())


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def near_lines(lines: DataFrame, distance: int, **options) -> DataFrame:
    """Links (a, b) between the ids of lines (id, line, n, sig) within the edit distance of each other."""
    pairs = candidates(lines, distance, **options)
    asked = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    few = asked.count() <= MOST_SENT
    texts = cut(lines.select("id", "line").join(F.broadcast(asked) if few else asked, "id"))
    pairs = pairs.join(texts.toDF("a", "la"), "a").join(texts.toDF("b", "lb"), "b")
    # written before the distance, whose lambda functions would keep the rest from being compiled
    pairs = cut(without_common_ends(pairs.where(keeps_segments(F.col("la"), F.col("lb"), distance)), "la", "lb"))
    return pairs.where(edit_distance(F.col("la"), F.col("lb"), distance) <= distance).select("a", "b")


def repeated_lines(docs: DataFrame, distance: int = 2, min_chars: int = 20) -> DataFrame:
    """doc_id, text_hash and dropped, the sorted positions (from 0) of the lines that repeat an earlier one; documents with any."""
    if not 0 <= distance < min(min_chars, 16):
        raise ValueError("distance must be below min_chars and 16")
    found = occurrences(docs)
    h1, h2 = F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")
    lines = found.groupBy("line").agg(F.count(F.lit(1)).alias("times")).withColumn("start", F.substring("line", 1, COUNTED))
    lines = save(lines.select(F.monotonically_increasing_id().alias("id"), "line", F.length("line").alias("n"), signature(F.col("line"), F.col("start")).alias("sig"), "times", h1, h2))
    roots = cut(components(near_lines(lines.where(F.col("n") >= min_chars), distance), "a", "b"))
    classed = lines.select("id", "times", "h1", "h2").join(roots, F.col("id") == F.col("node"), "left")
    known = classed.where("root is not null or times > 1").select("h1", "h2", F.coalesce("root", "id").alias("class"))
    place = F.struct("doc_id", "text_hash", "pos")
    placed = cut(found.select("doc_id", "text_hash", "pos", h1, h2).join(known, ["h1", "h2"]).drop("h1", "h2"))
    first = placed.groupBy("class").agg(F.min(place).alias("stays"))
    repeats = placed.join(first, "class").where(~place.eqNullSafe(F.col("stays")))
    return repeats.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def with_dropped(docs: DataFrame, distance: int, min_chars: int) -> DataFrame:
    """docs with __lf_dropped, the positions to drop, or null."""
    repeats = repeated_lines(docs, distance, min_chars).select(F.col("doc_id").alias("__lf_id"), F.col("text_hash").alias("__lf_hash"), F.col("dropped").alias("__lf_dropped"))
    hashed = docs.withColumn("__lf_text", F.xxhash64(F.col("text").cast("string")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__lf_id")) & (F.col("__lf_text") == F.col("__lf_hash"))
    return hashed.join(repeats, same, "left").drop("__lf_id", "__lf_hash", "__lf_text")


def line_dedup(docs: DataFrame, distance: int = 2, min_chars: int = 20) -> DataFrame:
    """docs with repeated lines taken out of text. Rows that lose all their words go."""
    d = with_dropped(docs, distance, min_chars)
    left = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("__lf_dropped", i)), "\n")
    d = d.withColumn("text", F.when(F.col("__lf_dropped").isNull(), F.col("text")).otherwise(left))
    return d.where(F.col("__lf_dropped").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop("__lf_dropped")


def line_digest(docs: DataFrame, distance: int = 2, min_chars: int = 20) -> DataFrame:
    """doc_id, n_lines, n_dropped and dropped (comma-joined positions), one row per row of docs."""
    d = docs.select("doc_id", F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1, F.lit(0)).alias("n_lines"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    r = repeated_lines(docs, distance, min_chars).withColumnsRenamed({"doc_id": "id", "text_hash": "hash"})
    j = d.join(r, d.doc_id.eqNullSafe(r.id) & (d.text_hash == r.hash), "left")
    return j.select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).alias("n_dropped"), F.coalesce(F.array_join(F.col("dropped").cast("array<string>"), ","), F.lit("")).alias("dropped"))
