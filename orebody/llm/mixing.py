"""Mixing sources to target weights, in DataFrame expressions only.

The words of a source, documents in a fixed pseudorandom order, are packed into blocks of fixed length. A source's
target in words becomes a quota of slots: whole epochs over its blocks, then as many blocks of one more epoch as the
rest needs, the last slot cut so that the target is met to the word. Each slot of an output shard draws its source with
probabilities in proportion to the quotas, so a shard's source counts are a multinomial draw. Prefix sums of the counts
over the shards number a source's draws; draw j of an epoch takes block permutation(j), and each epoch of each source
has a pseudorandom permutation of its own. Draws beyond a source's quota, about the square root of their number, pass
to the sources that were drawn too seldom: so every source meets its target and no block is taken more often than its
epochs. Slots and blocks join by (source, block index).

The permutations are swap-or-not shuffles: each round pairs x with key - x modulo n and a bit of the pair's larger
member decides whether they trade places; n may be any number below 2**61, and the rounds in reverse order are the
inverse.

Edge cases: null texts have no words; a source without words has target 0; null sources are one source, the last;
rows that agree in doc_id (null or not) and size follow each other and have the same total taken in any order; sources
whose level ties are ordered by code point; texts have no limit of length (mix() splits one text in one row); an empty
table gives no rows; extra columns of any name are kept by mix(). Sources are few: targets are made in one task, a row
a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebody.llm.common import SPACE_CLASS, materialize

BLANKS = " \t\n\x0b\x0c\r"
#: Fixed values of the pseudorandom bits: a prime modulus and two multipliers of linear congruential generators.
PRIME, FIRST, SECOND = (1 << 31) - 1, 48271, 69621
ROUNDS = 24
#: Slots that one exploded row makes, documents whose running sum one window makes, and rows of one window above that.
CHUNK, BUCKET, LEVEL = 4096, 1024, 4096
#: Rows of a table that may be broadcast.
SMALL = 200_000
LOW, SPREAD = 31, 7919  # bits of a number's lower part, and what the upper part is multiplied by


def _scatter(x: Column) -> Column:
    return x.cast("long") % PRIME * FIRST % PRIME * SECOND % PRIME


def _mixed(x: Column) -> Column:
    """A pseudorandom number below PRIME for a number below 2**62."""
    return _scatter(_scatter(x) + F.shiftright(x.cast("long"), LOW))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's argument is bound, not repeated."""
    return F.element_at(F.transform(F.array(value), body), 1)


def permuted(x: Column, n: Column, seed: Column, inverse: bool = False) -> Column:
    """Where the seed's permutation of 0..n-1 sends x."""

    def trade(x: Column, i: Column) -> Column:
        def with_key(one: Column) -> Column:
            key = one * (1 << LOW) + _scatter(one + 1)
            return _let((key % n - x + n) % n, lambda partner: F.when(swap(one, F.greatest(x, partner)), partner).otherwise(x))  # both are below n

        return _let(_scatter(seed * ROUNDS + i), with_key)

    def swap(one: Column, high: Column) -> Column:
        return F.shiftright(_scatter(one + high + F.shiftright(high, LOW) * SPREAD), 13) % 2 == 1

    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(order, x.cast("long"), trade)


def running(rows: DataFrame, by: str, at: str, value: str, name: str) -> DataFrame:
    """rows (one for each by and at, a number from 0 on) with the sum of value over the smaller at of its by.

    Sums are made over LEVEL numbers and then over those sums: no window holds all of one by.
    """
    c = F.col
    rows = rows.withColumn("__level", F.expr(f"`{at}` div {LEVEL}"))
    upper = rows.groupBy(c(by).alias("__by"), c("__level").alias("__l")).agg(F.sum(value).alias("__sum"))
    upper = upper.withColumn("__base", F.sum("__sum").over(Window.partitionBy("__by").orderBy("__l")) - c("__sum")).drop("__sum")
    rows = rows.withColumn(name, F.sum(value).over(Window.partitionBy(by, "__level").orderBy(at)) - c(value))
    both = rows.join(upper, c(by).eqNullSafe(c("__by")) & (c("__level") == c("__l")))
    return both.withColumn(name, (c(name) + c("__base")).cast("long")).drop("__level", "__by", "__l", "__base")


def n_words(text: Column) -> Column:
    core = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(BLANKS))
    return F.when(core == "", F.lit(0)).otherwise(F.size(F.split(core, SPACE_CLASS))).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """sizes (source, source_size; one row a source) with sid, weight and target.

    Sources by code point, null last, get the weights in turn. Targets are in proportion to the weights and sum to
    share times all words; those above `most` times their source stop there and the excess is shared again. Sorted by
    the level at which they are full, a source is full if the level after all fuller ones reaches
    its own; the first that is not full sets the level of all the rest.
    """
    every = Window.partitionBy(F.lit(0))
    rows = sizes.withColumn("sid", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("long"))
    rows = rows.withColumn("cap", F.col("source_size") * most)
    by = every.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("sid"))
    rows = rows.withColumn("fuller", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("rest", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("level", (F.sum("source_size").over(every) * F.lit(share) - F.col("fuller")) / F.col("rest"))
    rows = rows.withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    rows = rows.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * level))
    return rows.select("source", "source_size", "sid", "weight", "target")


def _quotas(sources: DataFrame, block: int, seed: int) -> DataFrame:
    """sources with blocks, epochs (whole ones), slots and last (words of the last slot)."""
    c = F.col
    rows = sources.where("source_size > 0").withColumn("blocks", F.ceil(c("source_size") / block).cast("long"))
    rows = rows.withColumn("words", F.floor("target").cast("long"))
    rows = rows.withColumn("epochs", F.expr("words div source_size")).withColumn("r", F.expr("words % source_size"))
    rows = rows.withColumn("short", c("source_size") - (c("blocks") - 1) * block)
    rows = rows.withColumn("p", permuted(c("blocks") - 1, c("blocks"), _seed(c("sid"), c("epochs"), seed), inverse=True))
    full = F.ceil(c("r") / block).cast("long")  # blocks for r words, if the short one is not among them
    more = 1 + F.ceil((c("r") - c("short")) / block).cast("long")
    before, within = c("r") <= c("p") * block, c("r") <= c("p") * block + c("short")
    m = F.when(before, full).when(within, c("p") + 1).otherwise(more)
    last = F.when(before, c("r") - (full - 1) * block).when(within, c("r") - c("p") * block).otherwise(c("r") - c("short") - (more - 2) * block)
    return rows.select("sid", "blocks", "short", (c("epochs") * c("blocks") + m).alias("slots"), F.when(m > 0, last).otherwise(F.lit(0)).alias("last"), "epochs", m.alias("m"))


def _seed(sid: Column, epoch: Column, seed: int) -> Column:
    return (F.lit(seed) * 1009 + sid * 31 + epoch).cast("long")


def draws(quotas: DataFrame, shard: int, seed: int) -> DataFrame:
    """shard, slot, sid: the source that each slot of each shard draws, in proportion to the quotas.

    quotas: sid, first (slots of the sources before) and slots. A slot draws a number below the sum of all quotas; the
    source is the one whose quota holds it, found by chunks of numbers.
    """
    c = F.col
    parts = int(quotas.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = quotas.agg(F.sum("slots").alias("total")).where("total > 0")
    shards = total.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (total - 1) div {shard * CHUNK})"))).repartition(parts, "chunk")
    shards = shards.withColumn("shard", F.explode(F.expr(f"sequence(chunk * {CHUNK}, least(chunk * {CHUNK} + {CHUNK - 1}, (total - 1) div {shard}))"))).repartition(parts, "shard")
    each = shards.select("shard", "total", F.explode(F.expr(f"sequence(0L, least({shard}L, total - shard * {shard}) - 1)")).alias("slot"))
    each = each.select("shard", "slot", F.pmod(F.xxhash64(F.lit(seed), "shard", "slot"), c("total")).alias("x"))
    held = quotas.select("sid", c("first").alias("lo"), (c("first") + c("slots")).alias("hi"), F.explode(F.expr(f"sequence(first div {CHUNK}, (first + slots - 1) div {CHUNK})")).alias("chunk"))
    each = each.withColumn("chunk", F.expr(f"x div {CHUNK}")).join(held, "chunk").where("lo <= x AND x < hi")
    return each.select("shard", "slot", "sid")


def shard_counts(drawn: DataFrame) -> DataFrame:
    """How many slots each output shard draws from each source, and how many those before it drew (base)."""
    return running(drawn.groupBy("shard", "sid").agg(F.count("*").alias("n")), "sid", "shard", "n", "base")


def slots(sources: DataFrame, block: int, seed: int = 7, shard: int = 1024) -> DataFrame:
    """One row a slot of the mix: shard, slot (place in the shard), sid, idx (block), words (that it takes)."""
    c = F.col
    every = Window.partitionBy(F.lit(0))
    quotas = _quotas(sources, block, seed).where("slots > 0")
    quotas = materialize(quotas.withColumn("first", F.sum("slots").over(every.orderBy("sid")) - c("slots")), "quotas")
    drawn = materialize(draws(quotas, shard, seed), "draws")
    counts = materialize(shard_counts(drawn), "counts")
    order = Window.partitionBy("shard", "sid").orderBy("slot")
    rows = drawn.withColumn("k", F.row_number().over(order) - 1).join(counts.select("shard", "sid", "base"), ["shard", "sid"])
    rows = rows.withColumn("j", c("base") + c("k"))
    # Sources that were drawn too often, and too seldom, by how much, and by how much those before them.
    got = quotas.select("sid", "slots").join(counts.groupBy("sid").agg(F.sum("n").alias("n")), "sid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    got = got.withColumn("over", F.greatest(c("n") - c("slots"), F.lit(0))).withColumn("under", F.greatest(c("slots") - c("n"), F.lit(0)))
    for x in ("over", "under"):
        got = got.withColumn(f"{x}_before", F.sum(x).over(every.orderBy("sid")) - c(x))
    got = materialize(got, "drawn")
    rows = rows.join(got.select("sid", "slots", "over_before"), "sid")
    fits = rows.where("j < slots").select("shard", "slot", "sid", "j")
    void = rows.where("j >= slots").select("shard", "slot", (c("over_before") + c("j") - c("slots")).alias("place"))
    short = got.where("under > 0").select("sid", "n", "under_before", F.explode(F.expr("sequence(0L, under - 1)")).alias("k"))
    moved = void.join(short.select("sid", (c("under_before") + c("k")).alias("place"), (c("n") + c("k")).alias("j")), "place").select("shard", "slot", "sid", "j")
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = fits.unionByName(moved).repartition(parts, "sid", "j").join(F.broadcast(quotas) if quotas.count() <= SMALL else quotas, "sid")
    rows = rows.withColumn("epoch", F.expr("j div blocks"))
    rows = rows.withColumn("idx", permuted(F.expr("j % blocks"), c("blocks"), _seed(c("sid"), c("epoch"), seed)))
    words = F.when((c("j") == c("slots") - 1) & (c("m") > 0), c("last")).when(c("idx") == c("blocks") - 1, c("short")).otherwise(F.lit(block))
    return rows.select("shard", "slot", "sid", "idx", words.cast("long").alias("words"))


def _bucket(buckets: int) -> Column:
    """A document's bucket: pseudorandom by doc_id and size, whatever the ids are like."""
    key = F.coalesce("doc_id", F.lit(0).cast("long")).bitwiseAND(F.lit((1 << 62) - 1))
    return _mixed(_mixed(key) + F.col("size")) % buckets


def placed(rows: DataFrame, count: int, **how) -> tuple[DataFrame, DataFrame]:
    """rows (source, doc_id, size, ...) with their place in their source's words, and the sources with targets.

    count: documents in all, which sets the number of buckets. Adds bucket, row (its number in the bucket), start, sid,
    source_size and target. The running sums are made in buckets of documents and then over the buckets, so that
    a large source is no single task's work.
    """
    c = F.col
    rows = rows.withColumn("bucket", _bucket(max(1, -(-count // BUCKET))))
    buckets = materialize(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    sources = materialize(targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), **how), "sources")
    few = buckets.count() <= SMALL  # 64 bytes a row
    s = sources.select(c("source").alias("s"), "source_size", "sid", "target")
    buckets = running(buckets, "source", "bucket", "words", "base").join(s, c("source").eqNullSafe(c("s")))
    buckets = buckets.select(c("source").alias("bs"), c("bucket").alias("bb"), "base", "source_size", "sid", "target")
    within = Window.partitionBy("source", "bucket").orderBy("doc_id", "size")
    rows = rows.withColumn("row", F.row_number().over(within))
    rows = rows.withColumn("start", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - c("size"))
    both = rows.join(F.broadcast(buckets) if few else buckets, c("source").eqNullSafe(c("bs")) & (c("bucket") == c("bb")))
    return both.withColumn("start", c("start") + c("base")).drop("bs", "bb", "base"), sources


def _pieces(rows: DataFrame, block: int) -> DataFrame:
    """A row for each block that a row's words touch: idx, a and b (the words' range in the block); null if none."""
    c = F.col
    spread = F.when(c("size") > 0, F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")))
    rows = rows.withColumn("idx", F.explode_outer(spread))
    return rows.withColumn("a", F.greatest(c("start") - c("idx") * block, F.lit(0))).withColumn("b", F.least(c("start") + c("size") - c("idx") * block, F.lit(block)))


def taken(docs: DataFrame, text: str = "text", block: int = 256, seed: int = 7, **how) -> DataFrame:
    """The columns of op7's contract: how many words of each document the mix takes."""
    c = F.col
    rows = materialize(docs.select(c("doc_id").cast("long").alias("doc_id"), c("source").cast("string").alias("source"), n_words(c(text)).alias("size")), "sizes")
    rows, sources = placed(rows, rows.count(), **how)
    got = slots(sources, block, seed).select(c("sid").alias("s"), c("idx").alias("i"), c("words"))
    # Merge: the slots grow with the corpus, which their estimated size does not show.
    pieces = _pieces(rows, block).join(got.hint("merge"), (c("sid") == c("s")) & (c("idx") == c("i")), "left")
    share = F.when(c("words").isNull(), F.lit(0)).otherwise(F.greatest(F.least(c("b"), c("words")) - c("a"), F.lit(0)))
    pieces = pieces.groupBy("sid", "bucket", "row", "doc_id", "size", "source_size", "target").agg(F.sum(share).cast("long").alias("taken"))
    return pieces.select("doc_id", "size", "source_size", "target", "taken")


def mix_rows(docs: DataFrame, text: str = "text", block: int = 256, seed: int = 7, shard: int = 1024, **how) -> DataFrame:
    """The mix itself: a row for each document piece of each slot: place, a struct of shard, slot and a, the place of the
    piece's first word in its block; and row, a struct of docs' columns, whose text is the piece.

    A piece keeps the white space that follows its words. n_chars, if docs has it, is the piece's length. Documents
    without words go.
    """
    c = F.col
    names = docs.columns
    core = F.btrim(F.coalesce(c(text).cast("string"), F.lit("")), F.lit(BLANKS))
    rows = docs.select(F.struct(*(c(f"`{x}`") for x in names if x != text)).alias("own"), core.alias("core"), c("doc_id").cast("long").alias("doc_id"), c("source").cast("string").alias("source"))
    rows, sources = placed(rows.withColumn("size", n_words(c("core"))).where("size > 0"), docs.count(), **how)
    each = lambda x: F.regexp_extract_all(x, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))

    def cuts(parts: Column) -> Column:
        def one(i: Column) -> Column:
            a = F.greatest(c("start") - i * block, F.lit(0))
            n = F.least(c("start") + c("size") - i * block, F.lit(block)) - a
            body = F.array_join(F.slice(parts, (i * block + a - c("start") + 1).cast("int"), n.cast("int")), "")
            return F.struct(i.alias("idx"), a.alias("a"), n.alias("n"), body.alias("body"))

        return F.transform(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")), one)

    # The words are bound once to a lambda's argument, and each piece holds its own words alone.
    pieces = F.flatten(F.transform(F.array(each(c("core"))), cuts))
    pieces = rows.select("own", "sid", F.explode(pieces).alias("x")).select("own", "sid", "x.*")
    got = slots(sources, block, seed, shard).select("shard", "slot", c("sid").alias("s"), c("idx").alias("i"), "words")
    both = pieces.join(got.hint("merge"), (c("sid") == c("s")) & (c("idx") == c("i")) & (c("words") > c("a")))
    cut = F.when(c("words") - c("a") >= c("n"), c("body")).otherwise(F.array_join(F.slice(each(c("body")), F.lit(1), (c("words") - c("a")).cast("int")), ""))
    both = both.withColumn("body", F.rtrim(cut, F.lit(BLANKS)))
    out = [c("body").alias(x) if x == text else F.length("body").cast("long").alias(x) if x == "n_chars" else c(f"own.`{x}`") for x in names]
    return both.select(F.struct("shard", "slot", "a").alias("place"), F.struct(*out).alias("row"))


def mix(docs: DataFrame, text: str = "text", block: int = 256, seed: int = 7, shard: int = 1024, **how) -> DataFrame:
    """The mix in the columns of docs: each partition holds whole shards, in the order of shards, slots and words."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = mix_rows(docs, text, block, seed, shard, **how)
    return rows.repartition(parts, "place.shard").sortWithinPartitions("place").select("row.*")


def sql(block: int = 256, seed: int = 7, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> str:
    """taken() in DuckDB SQL."""

    def scatter(x: str) -> str:
        return f"(({x}) % {PRIME} * {FIRST} % {PRIME} * {SECOND} % {PRIME})"

    def mixed(x: str) -> str:
        return scatter(f"{scatter(x)} + (({x}) >> {LOW})")

    def permuted_sql(x: str, n: str, s: str, inverse: bool = False) -> str:
        order = f"range({ROUNDS - 1}, -1, -1)" if inverse else f"range({ROUNDS})"
        one = scatter(f"({s}) * {ROUNDS} + i")
        partner = f"((({one} * {1 << LOW} + {scatter(f'{one} + 1')}) % {n} - x + {n}) % {n})"
        high = f"greatest(x, {partner})"
        bit = f"({scatter(f'{one} + {high} + ({high} >> {LOW}) * {SPREAD}')} >> 13) % 2"
        return f"list_reduce({order}, lambda x, i: CASE WHEN {bit} = 1 THEN {partner} ELSE x END, CAST({x} AS BIGINT))"

    bucket = f"{mixed(f'{mixed(f'(coalesce(doc_id, 0) & {(1 << 62) - 1})')} + size')} % (SELECT greatest(1, (count(*) + {BUCKET - 1}) // {BUCKET}) FROM documents)"
    weight = "CASE (sid % {}) {} END".format(len(weights), " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights)))
    return rf"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
    p AS (SELECT *, row_number() OVER () AS r, sum(size) OVER (PARTITION BY source ORDER BY bucket, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS start FROM (SELECT *, {bucket} AS bucket FROM d)),
    s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM s0), s2 AS (SELECT *, {weight} AS weight, source_size * {most} AS cap FROM s1),
    s3 AS (SELECT *, (CAST((SELECT sum(source_size) FROM s2) AS DOUBLE) * {share} - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
    s4 AS (SELECT source, source_size, sid, CASE WHEN cap <= weight * level THEN CAST(cap AS DOUBLE) ELSE weight * (SELECT max(level) FROM s3 WHERE cap > weight * level) END AS target FROM s3),
    q0 AS (SELECT *, CAST(ceil(source_size / {block}) AS BIGINT) AS blocks, CAST(floor(target) AS BIGINT) AS words FROM s4 WHERE source_size > 0),
    q1 AS (SELECT *, words // source_size AS epochs, words % source_size AS rest, source_size - (blocks - 1) * {block} AS short FROM q0),
    t AS (SELECT sid, blocks, short, rest, source_size, unnest(range(epochs + CASE WHEN rest > 0 THEN 1 ELSE 0 END)) AS epoch, epochs FROM q1),
    j AS (SELECT *, unnest(range(blocks)) AS j FROM t), k AS (SELECT *, {permuted_sql("j", "blocks", f"{seed} * 1009 + sid * 31 + epoch")} AS idx FROM j),
    l AS (SELECT *, CASE WHEN idx = blocks - 1 THEN short ELSE {block} END AS len FROM k),
    m AS (SELECT *, sum(len) OVER (PARTITION BY sid, epoch ORDER BY j ROWS UNBOUNDED PRECEDING) - len AS before FROM l),
    n AS (SELECT sid, idx, CASE WHEN epoch < epochs THEN len ELSE greatest(0, least(len, rest - before)) END AS words FROM m),
    o AS (SELECT p.r, n.idx, n.words, greatest(p.start - n.idx * {block}, 0) AS a, least(p.start + p.size - n.idx * {block}, {block}) AS b FROM p JOIN s4 ON p.source IS NOT DISTINCT FROM s4.source
        JOIN n ON n.sid = s4.sid AND n.idx >= p.start // {block} AND n.idx <= (p.start + p.size - 1) // {block} WHERE p.size > 0),
    u AS (SELECT r, sum(greatest(least(b, words) - a, 0)) AS taken FROM o GROUP BY r)
    SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM p JOIN s4 ON p.source IS NOT DISTINCT FROM s4.source LEFT JOIN u USING (r)"""
