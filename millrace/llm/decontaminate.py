"""Benchmark decontamination: SimHash of item-sized windows, found by Hamming blocks, verified on weighted shingles.

DataFrame functions only. Windows have as many shingles as the item; a text with fewer is one window. Fingerprints come
from running sums of bits, so a window costs the same at any size. Two of them that differ in at most RADIUS bits agree in
one of BLOCKS blocks up to RADIUS // BLOCKS bits; items are indexed under all values of a block that are so near.

Which texts are hashed at all is decided before, without loss: a window that is similar enough holds at least 6/7 of the
item's shingles (for 0.75), a shorter text at least 3/4, and so one of its anchor words. Windows begin at shingles that
any item has: one that begins elsewhere is no more similar than the one at its first such shingle.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import maybe_broadcast, row_key, shingle_hashes, words, written

WIDTH, SIMILARITY = 5, 0.75
#: Fingerprints of 64 bits that differ in up to RADIUS bits are candidates. Two windows of similarity 0.75 differ in 11
#: bits on average, with a deviation of 3: about 3 in 100,000 of those at the threshold are missed.
RADIUS, BLOCKS = 23, 8
#: Running sums begin anew after so many shingles, or after the longest window, so that no task holds a very long text.
STRETCH = 2048
#: Texts that tell rare words from common ones, about; they decide the cost only.
RARITY_SAMPLE = 3000


def _least_common(n: Column, m: Column, similarity: float) -> Column:
    """Of windows of n and m shingles: the smallest intersection at which intersection / union reaches similarity."""
    return F.ceil((n + m) * similarity / (1 + similarity) - 1e-9).cast("int")


def _anchors(items: DataFrame, sample: DataFrame, similarity: float) -> DataFrame:
    """(word, below): any text with a window similar enough to an item has one of these, and fewer words than below.

    Without a word that stands five words from either end and from the others picked, five shingles are missing.
    So for m missing shingles allowed, m // 5 + 1 such words suffice. Any choice finds all; words that are rare in
    the sample of texts (tokens), then long ones, are taken, as they leave fewer texts to hash. A text with fewer
    shingles than the item may lack more of them; the words for that matter only to texts with fewer words.
    """
    vocabulary = items.select(F.explode("tokens").alias("word")).distinct()
    seen = sample.select(F.explode(F.array_distinct("tokens")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    rare = written(vocabulary.join(seen, "word", "left").select("word", F.coalesce("df", F.lit(0)).alias("df")))
    n, size = F.col("n"), F.size("tokens")
    whole = F.struct((n - _least_common(n, n, similarity)).alias("allowed"), F.lit(2**31 - 1).alias("below"))
    # the smallest text that can be similar enough has all of its shingles in the item
    shorter = F.struct((n - F.ceil(n * similarity - 1e-9).cast("int")).alias("allowed"), size.alias("below"))
    each = items.select("item", "n", "tokens", F.explode(F.array(whole, shorter)).alias("rule")).select("item", "rule.*", size.alias("size"), F.posexplode("tokens").alias("pos", "word")).join(rare, "word")
    each = each.withColumn("needed", (F.col("allowed") / WIDTH).cast("int") + 1)
    # as many slots as words are needed, four positions between; short items: any word that is in more shingles than may be missing
    inner = F.col("size") >= 2 * WIDTH + 1
    slot_size = F.greatest(((F.col("size") - 2 * (WIDTH - 1)) / F.col("needed")).cast("int"), F.lit(1))
    at = F.col("pos") - (WIDTH - 1)
    gap = F.when(F.col("needed") > 1, WIDTH - 1).otherwise(0)
    slot = F.when(inner, F.floor(at / slot_size).cast("int")).otherwise(0)
    central = (F.col("pos") >= F.col("allowed")) & (F.col("pos") < F.col("size") - F.col("allowed"))
    fits = (~inner & central) | (inner & (at >= 0) & (F.col("slot") < F.col("needed")) & (F.pmod(at, slot_size) < slot_size - gap))
    best = Window.partitionBy("item", "below", "slot").orderBy("df", F.desc(F.length("word")), "word", "pos")
    each = each.withColumn("slot", slot).where(fits).withColumn("r", F.row_number().over(best))
    return each.where("r = 1").groupBy("word").agg(F.max("below").alias("below"))


def _lanes(x: Column, size: int) -> list[Column]:
    """The bits of x, several in a number, each with room to count size of them."""
    each = 63 // size.bit_length()
    out = []
    for low in range(0, 64, each):
        lane = F.lit(0).cast("long")
        for k, b in enumerate(range(low, min(low + each, 64))):
            lane = lane + F.shiftleft(F.shiftright(x, b).bitwiseAND(F.lit(1).cast("long")), k * size.bit_length())
        out.append(lane)
    return out


def _majority(lanes: list[Column], n: Column, size: int) -> Column:
    """The fingerprint of n shingles from the sums of their lanes: bits that are set in more than half of them."""
    width, fp = size.bit_length(), F.lit(0).cast("long")
    for low, lane in zip(range(0, 64, 63 // width), lanes, strict=True):
        for k, b in enumerate(range(low, min(low + 63 // width, 64))):
            ones = F.shiftright(lane, k * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            fp = fp.bitwiseOR(F.when(2 * ones > n, F.lit(-(2**63) if b == 63 else 1 << b)).otherwise(F.lit(0)).cast("long"))
    return fp


def _item_prints(of_items: DataFrame, longest: int) -> DataFrame:
    """item, width, n and item_fp."""
    lanes = [F.sum(lane).alias(f"s{k}") for k, lane in enumerate(_lanes(F.col("x"), longest))]
    sums = of_items.groupBy("item", "width", "n").agg(F.count("*").alias("_n"), *lanes)
    return sums.select("item", "width", "n", _majority([F.col(f"s{k}") for k in range(len(lanes))], F.col("_n"), longest).alias("item_fp"))


def _window_prints(wanted: DataFrame, hashed: DataFrame, longest: int) -> DataFrame:
    """wanted (text, width, n, m, start) with fp, from running sums over the shingles of hashed (text, hashes)."""
    # a stretch overlaps the next one by the longest window
    stretch = max(STRETCH, longest)
    at = wanted.select("*", F.floor(F.col("start") / stretch).cast("int").alias("part"))
    at = written(at.withColumns({"before": F.when(F.col("start") % stretch != 0, F.col("start") - 1), "last": F.col("start") + F.col("m") - 1}))
    parts = maybe_broadcast(written(at.select("text", "part").distinct()))
    ends = at.select("text", "part", F.col("last").alias("pos")).unionByName(at.where("before is not null").select("text", "part", F.col("before").alias("pos")))
    ends = maybe_broadcast(written(ends.distinct().withColumn("end", F.lit(True))))
    each = hashed.join(maybe_broadcast(written(at.select("text").distinct())), "text", "left_semi").select("text", F.posexplode("hashes").alias("pos", "x"))
    own = F.floor(F.col("pos") / stretch).cast("int")
    both = F.when((own > 0) & (F.col("pos") % stretch < longest), F.array(own, own - 1)).otherwise(F.array(own))
    each = each.select("text", "pos", "x", F.explode(both).alias("part")).join(parts, ["text", "part"], "left_semi").join(ends, ["text", "part", "pos"], "left")
    running = Window.partitionBy("text", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    most = stretch + longest
    sums = each.select("text", "part", "pos", "end", *[F.sum(lane).over(running).alias(f"s{k}") for k, lane in enumerate(_lanes(F.col("x"), most))])
    sums = written(sums.where("end").drop("end"))
    names = [c for c in sums.columns if c.startswith("s")]
    low = sums.select("text", "part", F.col("pos").alias("before"), *[F.col(c).alias(f"b{c}") for c in names])
    out = at.join(sums.withColumnRenamed("pos", "last"), ["text", "part", "last"]).join(low, ["text", "part", "before"], "left")
    return out.select("text", "width", "n", "m", "start", _majority([F.col(c) - F.coalesce(f"b{c}", F.lit(0)) for c in names], F.col("m"), most).alias("fp"))


def _blocks(fp: Column, errors: int) -> Column:
    """(block, its bits, also with up to so many of them changed) of a fingerprint."""
    size = 64 // BLOCKS
    changes = F.array(*[F.lit(sum(1 << b for b in some)) for k in range(errors + 1) for some in itertools.combinations(range(size), k)])

    def block(k: int) -> Column:
        bits = F.shiftrightunsigned(fp, k * size).bitwiseAND(F.lit((1 << size) - 1))
        return F.transform(changes, lambda x: F.struct(F.lit(k).alias("block"), bits.bitwiseXOR(x).alias("bits")))

    return F.explode(F.flatten(F.array(*map(block, range(BLOCKS)))))


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(_key, item_id, start, similarity): each document with a window like a benchmark item, its best window.

    Words are lower-cased runs without white space; shingles have five words (an item of fewer words is one shingle of
    all), weighted by how often they occur; similarity is the sum of minimal by the sum of maximal weights. Windows
    begin at every shingle that an item has; the last ones are moved back to end with the text, and a text with fewer
    shingles than the item is one window, compared as a whole. A fingerprint that differs in more than radius bits is no
    candidate. Null and blank texts and items match nothing. _key is
    row_key(doc_id, text): equal rows have equal results. Equal items have equal matches.
    """
    tokens = words(F.lower("text"))
    items = benchmark.select("item_id", "text").select("item_id", tokens.alias("tokens")).where(F.size("tokens") > 0)
    items = items.select(
        "item_id", "tokens", F.xxhash64("tokens").alias("item"), F.least(F.size("tokens"), F.lit(WIDTH)).alias("width"), F.greatest(F.size("tokens") - WIDTH + 1, F.lit(1)).alias("n")
    )
    items = written(items)
    one = items.dropDuplicates(["item"])
    # the width of short items: as many values as WIDTH at most
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())
    if not widths:
        return docs.select(row_key("doc_id", "text").alias("_key"), F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("start"), F.lit(0.0).alias("similarity")).limit(0)

    def by_width(frame: DataFrame, keep: list[str]) -> DataFrame:
        each = F.array(*[F.struct(F.lit(w).alias("width"), shingle_hashes(F.col("tokens"), w).alias("hashes")) for w in widths])
        return frame.select(*keep, F.explode(each).alias("e")).select(*keep, "e.*")

    of_items = written(by_width(one.withColumnRenamed("width", "own"), ["item", "own", "n"]).where("own = width").select("item", "width", "n", F.explode("hashes").alias("x")))
    share = max(1, int(1_000_000 * RARITY_SAMPLE / max(docs.count(), 1)))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share).select(tokens.alias("tokens"))
    anchors = maybe_broadcast(written(_anchors(one, sample, similarity)))

    told = docs.select(row_key("doc_id", "text").alias("_key"), tokens.alias("tokens"))
    found = told.select("_key", F.size("tokens").alias("words"), F.explode("tokens").alias("word")).join(anchors, "word").where("words < below")
    suspects = written(found.select("_key").distinct())
    texts = docs.select("doc_id", "text").withColumn("_key", row_key("doc_id", "text")).join(maybe_broadcast(suspects), "_key", "left_semi")
    hashed = by_width(texts.select("_key", tokens.alias("tokens")), ["_key"]).where(F.size("hashes") > 0).dropDuplicates(["_key", "width"])
    hashed = written(hashed.withColumn("text", F.monotonically_increasing_id()))  # written once, so a text keeps its number

    shingles = maybe_broadcast(written(of_items.select("width", "n", "x").distinct()))
    # a window may begin at any shingle of an item, and at the last place of a text that has one
    hits = hashed.select("text", "width", F.size("hashes").alias("size"), F.posexplode("hashes").alias("pos", "x")).join(shingles, ["width", "x"])
    # m: the shingles of the window, those of the item or of a text that has fewer
    hits = hits.where(F.col("size") >= F.col("n") * similarity - 1e-9).withColumn("m", F.least("n", "size"))
    wanted = written(hits.select("text", "width", "n", "m", F.least("pos", F.col("size") - F.col("m")).alias("start")).distinct())
    longest = items.agg(F.max("n")).head()[0]
    prints = _window_prints(wanted, hashed.select("text", "hashes"), longest)
    left = prints.select("*", _blocks(F.col("fp"), 0).alias("k")).select("text", "width", "n", "m", "start", "fp", "k.*")
    right = _item_prints(of_items, longest).select("item", "width", "n", "item_fp", _blocks(F.col("item_fp"), radius // BLOCKS).alias("k")).select("item", "width", "n", "item_fp", "k.*")
    near = left.join(maybe_broadcast(written(right)), ["width", "n", "block", "bits"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    near = written(near.select("text", "width", "n", "m", "start", "item").distinct())

    spots = near.groupBy("text").agg(F.collect_set(F.struct("width", "n", "m", "start")).alias("at"))
    windows = hashed.select("text", "hashes").join(maybe_broadcast(written(spots)), "text").select("text", "hashes", F.explode("at").alias("w")).select("text", "w.*", "hashes")
    mine = windows.select("text", "width", "n", "m", "start", F.explode(F.slice("hashes", F.col("start") + 1, F.col("m"))).alias("x"))
    theirs = maybe_broadcast(written(of_items.groupBy("item", "width", "n", "x").agg(F.count("*").alias("d"))))
    # shingles of items first: a window's others have no part in a similarity
    common = mine.join(theirs, ["width", "n", "x"]).groupBy("text", "item", "n", "m", "start", "x").agg(F.count("*").alias("c"), F.first("d").alias("d"))
    common = common.groupBy("text", "item", "n", "m", "start").agg(F.sum(F.least("c", "d")).alias("both"))
    scored = common.select("text", "item", "n", "m", "start", (F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("similarity")).where(F.col("similarity") >= similarity - 1e-12)
    scored = scored.join(near, ["text", "item", "n", "m", "start"], "left_semi")
    best = scored.groupBy("text", "item").agg(F.max("similarity").alias("similarity"), F.max_by("start", F.struct("similarity", -F.col("start"))).alias("start"))
    best = hashed.select("text", "_key").join(maybe_broadcast(written(best)), "text")
    return written(best.join(items.select("item", "item_id"), "item").select("_key", "item_id", "start", "similarity"))


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_items, item_ids (ascending), similarity (the best; null if none) and kept of every row of docs."""
    leaks = find_leaks(docs, benchmark).groupBy("_key").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("similarity"))
    rows = docs.select("doc_id", row_key("doc_id", "text").alias("_key")).join(maybe_broadcast(written(leaks)), "_key", "left")
    none = F.array().cast("array<bigint>")
    return rows.select(
        "doc_id", F.when(F.col("item_ids").isNull(), 0).otherwise(F.size("item_ids")).cast("long").alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"), "similarity", F.col("item_ids").isNull().alias("kept")
    )
