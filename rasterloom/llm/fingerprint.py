"""Document fingerprints by Order MinHash, in DataFrame functions alone.

A text's k-mers (runs of k units) are numbered by occurrence. Their hashes fall into `sketches` buckets; of each
bucket the two least are selected, put back in text order and hashed as a tuple. A tuple survives only if the
same k-mers keep their order, so the share of equal tuples follows edit distance rather than mere overlap.

Units are words (runs of non-space); texts of fewer than `short` words carry a second part over characters, and
two fingerprints are compared by that part if both have it, else by the word part if both have that.

Numbering without a join: the array of (hash, place) integers is sorted, runs of one hash are cut out, and the
place in the run is the occurrence. Every step is a linear pass or a sort of one row's array of integers.

Defined results: a null text is an empty text; a text without units has an empty fingerprint, alike (1.0) to an
empty one and to no other (0.0); equal texts have equal fingerprints; with fewer than k units the whole sequence is
the one k-mer; an empty table gives an empty table. `signatures` passes extra columns through, `edited_likeness` takes
and returns its own columns alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

PLACE = 31  # low bits of an entry: the place in the text, as far as a string can reach
RANGE_MB = 64  # megabytes of text in a range of keys at most
WORDS = r"[ \t\n\x0B\f\r]+"


def _kmers(units: Column, k: int) -> Column:
    """(33-bit hash << 31 | place) of every k-mer. Types without nulls let Spark sort them as primitives."""
    n = F.size(units)
    run = lambda i: F.xxhash64(*[F.get(units, i + j) for j in range(k)])
    entry = lambda i: F.coalesce(F.shiftleft(run(i), PLACE).bitwiseOR(i.cast("long")), F.lit(0).cast("long"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - F.lit(k), F.lit(0))), entry)).otherwise(_none())


def _none() -> Column:
    return F.slice(F.array(F.lit(0).cast("long")), 1, 0)


def _differs(a: Column, b: Column, low: int) -> Column:
    """Whether two integers differ above their `low` lowest bits; true if one of them is missing."""
    return F.coalesce(F.shiftrightunsigned(a.bitwiseXOR(b), low) != 0, F.lit(True))


def _later(entries: Column, starts: Column) -> Column:
    """Entries of the second and later occurrences, each with a hash of its own."""
    follow = lambda j: F.coalesce(F.get(starts, j + 1), F.size(entries))
    low = F.lit((1 << PLACE) - 1).cast("long")
    entry = lambda x, o: F.shiftleft(F.xxhash64(F.shiftright(x, PLACE), o), PLACE).bitwiseOR(x.bitwiseAND(low))
    runs = F.transform(starts, lambda s, j: F.when(follow(j) - s > 1, F.transform(F.slice(entries, s + 2, follow(j) - s - 1), entry)).otherwise(_none()))
    return F.coalesce(F.flatten(runs), _none())


def _tuples(entries: Column, firsts: Column, bits: int) -> Column:
    """For each bucket a 32-bit integer: the bucket on top, then the hash of its two least k-mers in text order."""
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE) - 1).cast("long"))
    kmer = lambda x: F.shiftright(x, PLACE)

    def code(i: Column) -> Column:
        x, y = F.get(entries, i), F.get(entries, i + 1)
        pair = F.when(_differs(x, y, 64 - bits), F.xxhash64(kmer(x))).when(place(x) < place(y), F.xxhash64(kmer(x), kmer(y))).otherwise(F.xxhash64(kmer(y), kmer(x)))
        return F.shiftleft(F.shiftrightunsigned(x, 64 - bits), 32 - bits).bitwiseOR(F.shiftrightunsigned(pair, 32 + bits))

    return F.transform(firsts, code)


def signatures(df: DataFrame, text: Column, name: str, k: int = 2, sketches: int = 64, short: int = 96) -> DataFrame:
    """df with `name`_w and `name`_c: the word part and the character part (empty if not needed) as array<bigint>.

    Each step is a column of its own: an expression inside a lambda would be evaluated again for every element.
    """
    bits = (sketches - 1).bit_length()
    steps = df.withColumn(f"{name}_u", F.filter(F.split(F.coalesce(text, F.lit("")), WORDS), lambda w: w != ""))
    steps = steps.withColumn(f"{name}_v", F.when(F.size(f"{name}_u") < short, F.split(F.coalesce(text, F.lit("")), "")).otherwise(F.array().cast("array<string>")))
    for part, units, size in (("w", f"{name}_u", k), ("c", f"{name}_v", 2 * k + 1)):
        at, r = f"{name}_{part}", f"{name}_r"
        e = F.col(at)
        steps = steps.withColumn(at, F.sort_array(_kmers(F.col(units), size)))
        starts = F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda i: _differs(F.get(e, i), F.get(e, i - 1), PLACE))
        steps = steps.withColumn(r, F.when(F.size(e) > 0, starts).otherwise(F.array().cast("array<int>")))
        both = F.sort_array(F.concat(F.transform(r, lambda i: F.coalesce(F.get(e, i), F.lit(0).cast("long"))), _later(e, F.col(r))))
        steps = steps.withColumn(at, F.when(F.size(r) == F.size(e), e).otherwise(both))
        firsts = F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda i: _differs(F.get(e, i), F.get(e, i - 1), 64 - bits))
        steps = steps.withColumn(r, F.when(F.size(e) > 0, firsts).otherwise(F.array().cast("array<int>")))
        steps = steps.withColumn(at, _tuples(e, F.col(r), bits)).drop(r)
    return steps.drop(f"{name}_u", f"{name}_v")


def as_text(name: str) -> Column:
    """The fingerprint as a string: hex words of the word part, then those of the character part."""
    part = lambda c: F.array_join(F.transform(F.col(c), lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")
    return F.concat(part(f"{name}_w"), F.when(F.size(f"{name}_c") > 0, F.concat(F.lit("-"), part(f"{name}_c"))).otherwise(F.lit("")))


def likeness(a: str, b: str, sketches: int = 64) -> Column:
    """Root of the share of equal tuples among the buckets that either text fills: a tuple holds two k-mers."""
    down = 32 - (sketches - 1).bit_length()

    def share(x: str, y: str) -> Column:
        buckets = F.size(F.array_union(F.transform(x, lambda e: F.shiftright(e, down)), F.transform(y, lambda e: F.shiftright(e, down))))
        return F.sqrt(F.size(F.array_intersect(x, y)).cast("double") / F.greatest(buckets, F.lit(1)))

    chars = (F.size(f"{a}_c") > 0) & (F.size(f"{b}_c") > 0)
    words = (F.size(f"{a}_w") > 0) & (F.size(f"{b}_w") > 0)
    none = (F.size(f"{a}_w") + F.size(f"{a}_c") + F.size(f"{b}_w") + F.size(f"{b}_c")) == 0
    return F.when(chars, share(f"{a}_c", f"{b}_c")).when(words, share(f"{a}_w", f"{b}_w")).when(none, F.lit(1.0)).otherwise(F.lit(0.0))


def _numbers(values: list[int]) -> Column:
    """An array of integers as one folded literal; a column a number would be slow to plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _below(edges: Column, many: int, key: Column) -> Column:
    """How many of the sorted edges are less than the key, by binary search."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, many.bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= many) & (F.get(edges, p + s - 1) < key), p + s).otherwise(p))


def with_next(df: DataFrame, key: str, value: Column, name: str, tie: Column, buckets: int, partitions: int) -> DataFrame:
    """df (distinct column names) with the value of the next row in descending key order; after the last comes the first.

    Keys are cut into ranges by their quantiles; a range's rows meet in one task of a single shuffle. A range's
    first row also goes to the range above it (the very first row to the lowest range), so no second pass is
    needed. What the driver sees is one key per range. Rows of one key (or none: they come last) are ordered by
    `tie`.
    """
    found = df.select(F.percentile_approx(F.col(key), [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0] if buckets > 1 else []
    edges = sorted(set(found or []))
    own = F.coalesce(_below(_numbers(edges), len(edges), F.col(key)), F.lit(0)) if edges else F.lit(0)
    # A null key comes after all others.
    own = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(own)
    tops = {r.b: r.k for r in df.groupBy(own.alias("b")).agg(F.max(key).alias("k")).collect()}
    if not tops:
        return df.withColumn(name, F.when(F.lit(False), value))
    have = sorted(tops)
    above = dict(zip(have, have[1:] + have[:1], strict=True))
    # By place: range -1 first. A range without rows is never asked for.
    places = range(-1, len(edges) + 1)
    b, copy, place, at_ = (common.free_name(df, c) for c in ("bucket", "copy", "place", "range"))
    df_ = df.withColumn(at_, own)
    here = F.col(at_) + 1
    top, up = F.get(_numbers([tops.get(p) or 0 for p in places]), here), F.get(_numbers([above.get(p, 0) for p in places]), here)
    first = F.col(key).isNull() | (F.col(key) == top)
    entry = lambda at, is_copy: F.struct(at.cast("int").alias("b"), F.lit(is_copy).alias("c"))
    at = df_.withColumn(place, F.explode(F.when(first, F.array(entry(F.col(at_), False), entry(up, True))).otherwise(F.array(entry(F.col(at_), False)))))
    at = at.withColumn(b, F.col(f"{place}.b")).withColumn(copy, F.col(f"{place}.c")).drop(place, at_)
    order = Window.partitionBy(b).orderBy(F.col(copy), F.col(key).desc_nulls_last(), tie)
    return at.repartition(partitions, b).withColumn(name, F.lead(value).over(order)).where(~F.col(copy)).drop(b, copy)


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of (doc_id, text), of the edited text whose second half gives way to the next text's start, and their likeness.

    A text's signature is made before the one shuffle and travels along with it, so the next document's is at hand.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = signatures(docs, F.col("text"), "own").withColumn("n_chars", F.char_length("text").cast("long"))
    size = int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // (RANGE_MB << 20) + 1)
    # Several ranges a task even out what hashing their numbers to tasks makes uneven.
    pairs = with_next(base, "doc_id", F.struct("text", "own_w", "own_c"), "then", F.xxhash64("text"), 8 * partitions, partitions)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    # Without a next document (a table of one row) the document follows itself.
    then = lambda c: F.coalesce(F.col(f"then.{c}"), F.col(c))
    both = pairs.withColumn("edited", F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left(then("text"), half))).withColumn("next_w", then("own_w")).withColumn("next_c", then("own_c")).drop("then", "text")
    both = signatures(both.withColumn("edited_sha256", F.sha2("edited", 256)), F.col("edited"), "edit").drop("edited")
    return both.select("doc_id", "n_chars", "edited_sha256", as_text("own").alias("fingerprint"), as_text("edit").alias("edited_fingerprint"), likeness("own", "edit").alias("near_edited"), likeness("own", "next").alias("near_next"))
