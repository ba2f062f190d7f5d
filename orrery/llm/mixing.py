"""Mixing sources to target weights (operator 6), in DataFrame functions only.

The words of a source, its documents laid end to end, are packed into blocks of a fixed number
of words. The mix is a list of block slots in output shards of a fixed number of slots. Every
shard draws its sources' counts: a source gets the whole part of its expected count, and the
slots that are left are a multinomial draw by the fractions, so each count's mean is exact and
sums over shards stray from the target by about the root of the number of shards. A source's
slots, numbered through shard by shard, go through pseudorandom permutations of its block
indices, one permutation for each pass over the source, and the blocks are joined by index.
All randomness is integer arithmetic on (seed, source rank, number), so reruns agree on any
cluster.

Sums along a source are never one window: documents lie in small buckets, buckets in
superbuckets, and each level is summed by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.rows import ROW, with_row_key
from orrery.staging import Stages

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 128
SHARD_SLOTS = 1 << 10
MAX_REPEATS = 3
SEED = 17
ROUNDS = 16
#: Documents of a bucket, and buckets of a superbucket, on average.
BUCKET_DOCS, BUCKETS = 64, 1024
#: Slots that one exploded row makes, and shards whose counts are summed as one.
CHUNK = SHARDS = 1 << 12
#: Equal cells that the range of a multinomial draw is cut into, to find a draw's source by an equi-join.
CELLS = 1 << 12
P31 = 2147483647  # 2^31 - 1, the modulus of all hashing here


def _mix(value: str, key: str) -> str:
    """SQL for a pseudorandom integer in [0, 2^31 - 1), in terms that any 64-bit engine shares."""
    inner = f"((({value}) % {P31}) * 48271 + ({key})) % {P31}"
    return f"((({inner}) * (({inner}) + 69621)) % {P31})"


def with_permuted(rows: DataFrame, name: str, slot: str, size: str, key: str) -> DataFrame:
    """``rows`` and a column ``name``: a pseudorandom bijection of [0, size), the swap-or-not shuffle.

    Each round pairs x with (k - x) mod size and swaps by one bit of a hash of the pair, which
    permutes any size exactly and needs no table. A round is two projections, so that its terms are
    computed once and in generated code.
    """
    kept = [f"`{c}`" for c in rows.columns]
    rows = rows.selectExpr(*kept, f"CAST({slot} AS BIGINT) AS __x", f"CAST({size} AS BIGINT) AS __size", f"CAST({key} AS BIGINT) AS __key")
    for r in range(1, ROUNDS + 1):
        k = _mix(f"{r * 7919}L", "__key + 1")
        rows = rows.selectExpr(*kept, "__x", "__size", "__key", f"(({k}) % __size + __size - __x) % __size AS __partner")
        bit = f"({_mix('greatest(__x, __partner)', f'__key + {r * 104729 + 11}L')} div 65536) % 2"
        rows = rows.selectExpr(*kept, f"CASE WHEN {bit} = 1 THEN __partner ELSE __x END AS __x", "__size", "__key")
    # The optimizer traces a join key to its origin by writing all projections out as one term; it stops at a generator.
    return rows.selectExpr(*kept, f"explode(array(__x)) AS {name}")


def targets(sizes: DataFrame, seed: int = SEED) -> DataFrame:
    """From (source, words, docs) to one row per source with its target and slots.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share all words; a target
    stops at ``MAX_REPEATS`` times its source's size and the excess is shared anew by weight
    until none is above. That fixed point has a closed form: with sources ordered by size over
    weight, a prefix of them is capped and one level serves the others.
    """
    everyone = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("rank", F.row_number().over(everyone).cast("long") - 1).withColumn("weight", F.col("rank") % 3 + 1)
    ranked = ranked.withColumn("cap", F.col("words") * MAX_REPEATS).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    level = (F.sum("words").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level)
    # The first source, in that order, whose cap is not below its level ends the capped prefix.
    ranked = ranked.withColumn("share", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "rank", "level"))).over(whole))
    open_ = F.struct("ratio", "rank") >= F.struct(F.col("share.ratio"), F.col("share.rank"))
    ranked = ranked.withColumn("target", F.when(open_, F.col("share.level") * F.col("weight")).otherwise(F.col("cap").cast("double")))
    blocks = F.ceil(F.col("words") / BLOCK_WORDS).cast("long")
    passes = F.floor(F.col("target") / F.col("words")).cast("long")
    rest = F.least(F.round((F.col("target") - passes * F.col("words")) / BLOCK_WORDS).cast("long"), blocks)
    slots = F.when(F.col("words") > 0, F.least(passes * blocks + rest, blocks * MAX_REPEATS)).otherwise(F.lit(0))
    return ranked.select(
        "source", "rank", "docs", F.col("words").alias("source_size"), "target", blocks.alias("blocks"), slots.cast("long").alias("slots"),
        (F.col("rank") * 1000003 % P31 + seed).alias("key"),
    )


class Mix:
    """The mix of one table: every part is a stage table or a small plan over one."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED):
        self.seed = seed
        self.stages = Stages(docs.sparkSession, "mixing")
        self.docs, _ = with_row_key(docs, doc_id, self.stages)
        size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
        rows = self.docs.select(F.col(ROW).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size"))
        #: One row per document; ``row`` tells rows of one id apart.
        self.rows = self.stages.save(rows, "rows")
        per_source = self.rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
        self.sources = self.stages.save(targets(per_source, seed), "sources")
        few = self.sources.count() <= 10_000
        self.near = F.broadcast if few else (lambda df: df)

    def _with_source(self, rows: DataFrame) -> DataFrame:
        known = self.near(self.sources.withColumnRenamed("source", "s"))
        return rows.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s")

    def spans(self) -> DataFrame:
        """Every non-empty document's place in its source: words [``first``, ``first`` + size)."""
        bucket = F.expr(_mix("coalesce(doc_id, 0)", "key")) % F.ceil(F.col("docs") / BUCKET_DOCS).cast("long")
        rows = self._with_source(self.rows.where("size > 0")).withColumn("bucket", bucket)
        rows = rows.withColumn("super", F.floor(F.col("bucket") / BUCKETS).cast("long"))

        def before(*order: str):
            return lambda *keys: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

        per_bucket = rows.groupBy("rank", "super", "bucket").agg(F.sum("size").alias("words"))
        per_super = per_bucket.groupBy("rank", "super").agg(F.sum("words").alias("words"))
        super_start = per_super.select("rank", "super", F.coalesce(F.sum("words").over(before("super")("rank")), F.lit(0)).alias("at"))
        bucket_start = per_bucket.withColumn("in_super", F.coalesce(F.sum("words").over(before("bucket")("rank", "super")), F.lit(0)))
        bucket_start = bucket_start.join(super_start, ["rank", "super"]).select("rank", "bucket", (F.col("at") + F.col("in_super")).alias("at"))
        inside = F.coalesce(F.sum("size").over(before("doc_id", "row")("rank", "bucket")), F.lit(0))
        rows = rows.withColumn("inside", inside).join(bucket_start, ["rank", "bucket"])
        return rows.select("row", "doc_id", "rank", "size", (F.col("at") + F.col("inside")).alias("first"))

    def pieces(self) -> DataFrame:
        """The documents' parts by block: words [``start``, ``start`` + ``words``) of a document lie in ``block``."""
        spans = self.spans()
        last = F.floor((F.col("first") + F.col("size") - 1) / BLOCK_WORDS).cast("long")
        cut = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / BLOCK_WORDS).cast("long"), last)))
        start = F.greatest(F.col("block") * BLOCK_WORDS - F.col("first"), F.lit(0))
        end = F.least((F.col("block") + 1) * BLOCK_WORDS - F.col("first"), F.col("size"))
        return cut.select("row", "doc_id", "rank", "block", F.col("first").alias("at"), start.alias("start"), (end - start).alias("words"))

    def _numbered(self, table: DataFrame, count: str, keep: list[str]) -> DataFrame:
        """``count`` rows for each row of ``table``, numbered by ``i``: in chunks, dealt out before they expand."""
        chunks = table.where(F.col(count) > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col(count) - 1) / CHUNK).cast("long"))))
        # A given number of partitions: by their bytes these few rows would be put together again.
        ways = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = chunks.repartition(ways, *[F.col(c) for c in [*keep, "chunk"]])
        last = F.least((F.col("chunk") + 1) * CHUNK, F.col(count)) - 1
        return dealt.withColumn("i", F.explode(F.sequence(F.col("chunk") * CHUNK, last))).drop("chunk")

    def shard_counts(self) -> DataFrame:
        """(rank, shard, n, from, key, blocks): how many slots of each source every output shard has, and how many are before them."""
        known = self.sources.select("rank", "key", "slots", "blocks")
        total = F.sum("slots").over(Window.partitionBy(F.lit(1)))
        # Two kinds of shards: full ones, and one with the slots that are left.
        kinds = F.array(
            F.struct(F.lit(0).alias("kind"), F.lit(SHARD_SLOTS).cast("long").alias("size"), F.expr(f"total div {SHARD_SLOTS}").alias("shards"), F.lit(0).cast("long").alias("first")),
            F.struct(F.lit(1).alias("kind"), F.expr(f"total % {SHARD_SLOTS}").alias("size"), F.lit(1).cast("long").alias("shards"), F.expr(f"total div {SHARD_SLOTS}").alias("first")),
        )
        parts = known.withColumn("total", total).where("total > 0").select("*", F.explode(kinds).alias("k")).select("*", "k.*").where("size * shards > 0")
        parts = parts.withColumn("whole", F.expr("size * slots div total")).withColumn("rest", F.expr("size * slots % total"))
        up_to = Window.partitionBy("kind").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        parts = parts.withColumn("high", F.sum("rest").over(up_to)).withColumn("span", F.sum("rest").over(Window.partitionBy("kind")))
        parts = self.stages.save(parts.withColumn("draws", F.expr("span div total")).withColumn("width", F.expr(f"(span + {CELLS - 1}) div {CELLS}")), "parts")

        of_kind = parts.groupBy("kind").agg(*[F.first(c).alias(c) for c in ("shards", "first", "draws", "span", "width")])
        number = "(shard * draws + j)"
        spot = f"({_mix(number, str(self.seed * 2 + 101))} * {P31} + {_mix(number, str(self.seed * 3 + 65537))}) % span"
        drawn = self._numbered(of_kind.where("draws > 0"), "shards", ["kind"]).withColumn("shard", F.expr("first + i"))
        drawn = drawn.withColumn("j", F.explode(F.expr("sequence(0L, draws - 1)"))).withColumn("u", F.expr(spot)).withColumn("cell", F.expr("u div width"))
        low = F.col("high") - F.col("rest")
        cells = parts.where("rest > 0").select("kind", "rank", low.alias("low"), "high", F.explode(F.expr("sequence((high - rest) div width, (high - 1) div width)")).alias("cell"))
        drawn = drawn.join(self.near(cells), ["kind", "cell"]).where("low <= u and u < high").select("rank", "shard", F.lit(1).cast("long").alias("n"))
        sure = self._numbered(parts.where("whole > 0").select("kind", "rank", "whole", "shards", "first"), "shards", ["kind", "rank"]).select("rank", F.expr("first + i").alias("shard"), F.col("whole").alias("n"))
        counts = self.stages.save(sure.unionByName(drawn).groupBy("rank", "shard").agg(F.sum("n").alias("n")).withColumn("super", F.expr(f"shard div {SHARDS}")), "counts")

        def before(column: str, order: str, *keys: str) -> Column:
            return F.coalesce(F.sum(column).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

        per_super = counts.groupBy("rank", "super").agg(F.sum("n").alias("words")).withColumn("at", before("words", "super", "rank")).drop("words")
        counts = counts.withColumn("inside", before("n", "shard", "rank", "super")).join(per_super, ["rank", "super"])
        counts = counts.join(self.near(known.drop("slots")), "rank").withColumn("from", F.col("at") + F.col("inside"))
        # No block is taken more than MAX_REPEATS times, whatever was drawn.
        counts = counts.withColumn("n", F.least("n", F.col("blocks") * MAX_REPEATS - F.col("from"))).where("n > 0")
        return counts.select("rank", "shard", "n", "from", "key", "blocks")

    def slots(self) -> DataFrame:
        """(rank, shard, position, lap, block): what every output shard takes, in order."""
        each = self._numbered(self.shard_counts(), "n", ["rank", "shard"]).withColumn("number", F.col("from") + F.col("i"))
        each = each.select("rank", "shard", F.col("i").alias("position"), F.expr("number div blocks").alias("lap"), F.expr("number % blocks").alias("at"), "blocks", "key")
        return with_permuted(each, "block", "at", "blocks", "key + lap * 31337").select("rank", "shard", "position", "lap", "block")

    def by_block(self, *aggregates: Column) -> DataFrame:
        """A row for each block that is taken, to be joined by shuffle: the few rows that slots are made of look like a table to broadcast."""
        return self.slots().groupBy("rank", "block").agg(*aggregates).hint("merge")

    def plan(self) -> DataFrame:
        """(__mix_row, __mix_lead, __mix_parts): for every document, the slots of each of its parts, in the order of the parts."""
        slots = self.by_block(F.collect_list(F.struct("shard", "position")).alias("slots"))  # MAX_REPEATS at most
        parts = self.pieces().join(slots, ["rank", "block"], "left").withColumn("lead", F.when(F.col("start") == 0, F.col("at") % BLOCK_WORDS).cast("int"))
        plan = parts.groupBy(F.col("row").alias("__mix_row")).agg(F.max("lead").alias("__mix_lead"), F.array_sort(F.collect_list(F.struct("block", "slots"))).alias("__mix_parts"))
        return plan.where(F.exists("__mix_parts", lambda p: p["slots"].isNotNull()))

    def taken(self) -> DataFrame:
        """One row per document: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken``."""
        draws = self.by_block(F.count("*").alias("times"))
        used = self.pieces().join(draws, ["rank", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        rows = self._with_source(self.rows).join(used, "row", "left")
        return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """What the mix takes of every document, with production parameters.

    One row per row of ``docs``. A null text has size 0, a null source is a source of its own,
    a null id is kept, repeated rows are separate documents, an empty table gives no rows and
    other columns are ignored. No document is taken more than ``MAX_REPEATS`` times; a source's
    words miss its target by two blocks and what the draws stray, which is less than a block
    for each shard and about the root of their number.
    """
    return Mix(docs).taken()


def mixed_texts(docs: DataFrame) -> DataFrame:
    """The mix itself in the columns of documents: one row per document part and slot that takes it.

    ``text`` is the part's words with the white space between them, ``n_chars`` its code points.
    A document that one block holds is given with its whole text.
    """
    mix = Mix(docs)
    plan = mix.stages.save(mix.plan(), "plan")
    # Filler words before a text let one pattern cut it at its blocks' bounds; they are taken off again.
    # By shuffle, too: the plan is many times as large as its file.
    rows = mix.docs.join(plan.hint("merge"), F.col(ROW) == F.col("__mix_row")).withColumn("__mix_text", F.concat(F.expr("repeat('x ', __mix_lead)"), "text"))
    chunks = F.regexp_extract_all("__mix_text", F.lit(r"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){1,%d}" % BLOCK_WORDS), F.lit(0))
    rows = rows.select("*", F.posexplode(F.arrays_zip(chunks.alias("chunk"), F.col("__mix_parts.slots").alias("slots"))).alias("__mix_at", "__mix_cut"))
    rows = rows.where(F.col("__mix_cut.slots").isNotNull()).withColumn("__mix_slot", F.explode("__mix_cut.slots"))
    piece = F.when(F.col("__mix_at") == 0, F.expr("substring(__mix_cut.chunk, 2 * __mix_lead + 1)")).otherwise(F.col("__mix_cut.chunk"))
    cut = F.regexp_replace(piece, r"^[\x20\x09-\x0D]+", "")
    rows = rows.withColumn("text", F.when(F.size("__mix_parts") == 1, F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def _oracle() -> str:
    """The same mix for DuckDB: the shuffle's rounds become nested selects, and a draw finds its source by its range."""

    def sql(text: str) -> str:
        return text.replace(" div ", " // ")

    rounds = "SELECT rank, blocks, key + (number // blocks) * 31337 AS k0, number % blocks AS x FROM numbered"
    for r in range(1, ROUNDS + 1):
        partner = f"(({_mix(f'CAST({r * 7919} AS BIGINT)', 'k0 + 1')}) % blocks + blocks - x) % blocks"
        bit = sql(f"({_mix('greatest(x, y)', f'k0 + {r} * 104729 + 11')} div 65536) % 2")
        rounds = f"SELECT rank, blocks, k0, CASE WHEN {bit} = 1 THEN y ELSE x END AS x FROM (SELECT *, {partner} AS y FROM ({rounds}))"
    return f"""
WITH rows0 AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents),
sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS words, count(*) AS docs FROM rows0 GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM sizes),
weighed AS (
  SELECT *, rank % 3 + 1 AS weight, words * {MAX_REPEATS} AS cap, CAST(words * {MAX_REPEATS} AS DOUBLE) / (rank % 3 + 1) AS ratio FROM ranked),
leveled AS (
  SELECT *, CAST(sum(words) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM weighed),
first_open AS (
  SELECT ratio AS r0, rank AS k0, level AS l0 FROM leveled WHERE ratio >= level ORDER BY ratio, rank LIMIT 1),
aimed AS (
  SELECT *, CASE WHEN ratio > r0 OR (ratio = r0 AND rank >= k0) THEN l0 * weight ELSE CAST(cap AS DOUBLE) END AS target
  FROM leveled, first_open),
planned AS (
  SELECT *, CAST(ceil(words / {BLOCK_WORDS}.0) AS BIGINT) AS blocks, CAST(floor(target / words) AS BIGINT) AS passes, rank * 1000003 % {P31} + {SEED} AS key FROM aimed),
sources AS (
  SELECT *, CASE WHEN words > 0 THEN least(passes * blocks + least(CAST(round((target - passes * words) / {BLOCK_WORDS}) AS BIGINT), blocks), blocks * {MAX_REPEATS}) ELSE 0 END AS slots
  FROM planned),
placed AS (
  SELECT r.doc_id, s.rank, r.size, {_mix('coalesce(r.doc_id, 0)', 's.key')} % CAST(ceil(s.docs / {BUCKET_DOCS}.0) AS BIGINT) AS bucket
  FROM rows0 r JOIN sources s ON r.source IS NOT DISTINCT FROM s.source WHERE r.size > 0),
spans AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY rank ORDER BY bucket, doc_id) AS BIGINT) - size AS pos FROM placed),
cut AS (
  SELECT *, unnest(range(pos // {BLOCK_WORDS}, (pos + size - 1) // {BLOCK_WORDS} + 1)) AS block FROM spans),
pieces AS (
  SELECT doc_id, rank, block, least((block + 1) * {BLOCK_WORDS} - pos, size) - greatest(block * {BLOCK_WORDS} - pos, 0) AS words FROM cut),
kinds AS (
  SELECT 0 AS kind, CAST({SHARD_SLOTS} AS BIGINT) AS size, CAST(sum(slots) AS BIGINT) // {SHARD_SLOTS} AS shards, CAST(0 AS BIGINT) AS first, CAST(sum(slots) AS BIGINT) AS total FROM sources
  UNION ALL SELECT 1, CAST(sum(slots) AS BIGINT) % {SHARD_SLOTS}, 1, CAST(sum(slots) AS BIGINT) // {SHARD_SLOTS}, CAST(sum(slots) AS BIGINT) FROM sources),
parts AS (
  SELECT kind, rank, shards, first, total, size * slots // total AS whole, size * slots % total AS rest FROM sources, kinds WHERE size * shards > 0),
ranged AS (
  SELECT *, CAST(sum(rest) OVER (PARTITION BY kind ORDER BY rank) AS BIGINT) AS high, CAST(sum(rest) OVER (PARTITION BY kind) AS BIGINT) AS span FROM parts),
tries AS (
  SELECT kind, span, shard * (span // total) + unnest(range(span // total)) AS g
  FROM (SELECT kind, span, total, unnest(range(first, first + shards)) AS shard FROM (SELECT DISTINCT kind, shards, first, total, span FROM ranged))),
spots AS (
  SELECT kind, ({_mix('g', str(SEED * 2 + 101))} * {P31} + {_mix('g', str(SEED * 3 + 65537))}) % span AS u FROM tries),
drawn AS (
  SELECT rank, count(*) AS n FROM spots JOIN ranged USING (kind) WHERE high - rest <= u AND u < high GROUP BY rank),
numbered AS (
  SELECT rank, blocks, key, unnest(range(0, least(blocks * {MAX_REPEATS}, sure + coalesce(n, 0)))) AS number
  FROM sources JOIN (SELECT rank, CAST(sum(whole * shards) AS BIGINT) AS sure FROM parts GROUP BY rank) USING (rank) LEFT JOIN drawn USING (rank)),
draws AS (
  SELECT rank, x AS block, count(*) AS times FROM ({rounds}) GROUP BY rank, x),
used AS (
  SELECT doc_id, sum(words * times) AS taken FROM pieces JOIN draws USING (rank, block) GROUP BY doc_id)
SELECT r.doc_id, r.size, s.words AS source_size, s.target, CAST(coalesce(u.taken, 0) AS BIGINT) AS taken
FROM rows0 r JOIN sources s ON r.source IS NOT DISTINCT FROM s.source LEFT JOIN used u ON r.doc_id = u.doc_id
"""


ORACLE_SQL = _oracle()
