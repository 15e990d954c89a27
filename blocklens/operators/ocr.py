"""Choosing between text layers: native blocks and one or two OCR engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import text as tx

BOX_COLS = ("x0", "y0", "x1", "y1")
PAGE = ["doc_id", "page"]
#: Grid cells in points; a box that spans more of them is listed on a coarse grid.
CELL, LARGE_CELLS = 64.0, 4


def clean_words(words: DataFrame, *, min_conf: int = 10, strict: bool = False) -> DataFrame:
    """OCR words as boxes in points. Engine 1 reports a confidence and is filtered by it."""
    floor = max(0, min(min_conf, 100))
    floor = max(floor, 30) if strict else floor
    t = tx.strip(F.coalesce("text", F.lit("")))
    ok = (t != "") & ((F.col("engine") != 1) | ((F.col("conf") >= 0) & (F.col("conf") >= floor)))
    b = geo.pixel_box(*(F.col(c) for c in ("left", "top", "width", "height", "scale_x", "scale_y")))
    return words.filter(ok).select(
        *PAGE, "engine", "ocr_pass", "dpi", F.col("word_seq").alias("block_seq"), t.alias("text"),
        *[b[c].alias(c) for c in BOX_COLS], F.lit("ocr").alias("source"))


def polygon_words(words: DataFrame) -> DataFrame:
    """Words given by a polygon (array<struct<x,y>>) as boxes in points."""
    b = geo.polygon_box(F.col("polygon"), F.col("scale_x"), F.col("scale_y"))
    return words.withColumn("_b", b).select(
        *[c for c in words.columns if c != "polygon"], *[F.col(f"_b.{c}").alias(c) for c in BOX_COLS])


def drop_stamps(blocks: DataFrame) -> DataFrame:
    t = tx.strip(F.col("text"))
    return blocks.filter((t != "") & ~tx.is_stamp(t))


def page_needs_ocr(native: DataFrame, *, min_page_chars: int = 22, min_native_score: int = 20) -> DataFrame:
    """``weak`` per page that has native blocks; a page without any is weak as well."""
    chars_min, score_min = max(8, min(min_page_chars, 200)), max(0, min(min_native_score, 500))
    t = tx.strip(F.col("text"))
    n = tx.printable_chars(F.col("text"))
    clean = F.when((t != "") & ~tx.is_stamp(t), n).otherwise(0)
    return native.groupBy(*PAGE).agg(F.sum(n).alias("page_chars"), F.sum(clean).alias("native_score")).withColumn(
        "weak", (F.col("page_chars") < chars_min) | (F.col("native_score") < score_min))


def layer_stats(words: DataFrame) -> DataFrame:
    """Size of each engine's result on a page and pass: blocks, characters, printable characters."""
    return words.groupBy(*PAGE, "ocr_pass", "engine").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"),
        F.sum(tx.printable_chars(F.col("text"))).alias("printable"), F.max("dpi").alias("dpi"))


def second_engine_skippable(printable: Column, words: Column, *, always: bool = False, never: bool = False,
                            sufficient_chars: int = 78) -> Column:
    """The first engine filled the page: long enough and with enough words."""
    if always:
        return F.lit(False)
    if never:
        return F.lit(True)
    if sufficient_chars <= 0:
        return F.lit(False)
    return (printable >= 48) & (words >= 10) & (printable >= sufficient_chars)


def pick_engine(stats: DataFrame, *, ink: bool = False, always: bool = False, never: bool = False,
                sufficient_chars: int = 78) -> DataFrame:
    """Engine to use per page and pass. The second one counts unless it could be skipped."""
    def of(engine: int, c: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("engine") == engine, F.col(c))), F.lit(0)).alias(f"{c}{engine}")
    wide = stats.groupBy(*PAGE, "ocr_pass").agg(
        *[of(e, c) for e in (1, 2) for c in ("n", "chars", "printable")], F.max("dpi").alias("dpi"))
    skip = F.lit(False) if ink else second_engine_skippable(
        F.col("printable1"), F.col("n1"), always=always, never=never, sufficient_chars=sufficient_chars)
    n1, n2, c1, c2 = (F.col(x) for x in ("n1", "n2", "chars1", "chars2"))
    second = ~skip & (n2 > 0) & ((c2 >= c1 * 0.68) | (n2 >= F.greatest(F.lit(3), n1))
                                 | ((c2 > c1 * 0.5) & (n2 > n1)))
    engine = F.when(second, 2).when(n1 > 0, 1).when(~skip & (n2 > 0), 2)
    return wide.withColumn("engine", engine).withColumn(
        "printable", F.when(engine == 2, F.col("printable2")).otherwise(F.col("printable1")))


def retry_dpi(dpi: Column) -> Column:
    """Resolution of the second attempt at a page with little text."""
    return F.least(F.greatest((dpi * F.lit(1.28)).cast("int"), dpi + 24), F.lit(228))


def pick_pass(picked: DataFrame) -> DataFrame:
    """First pass, unless it is poor (and of low resolution) and the second one found more."""
    of = lambda n, c: F.max(F.when(F.col("ocr_pass") == n, F.col(c)))
    both = picked.filter(F.col("engine").isNotNull()).groupBy(*PAGE).agg(
        of(1, "engine").alias("e1"), of(1, "printable").alias("p1"), of(1, "dpi").alias("dpi1"),
        of(2, "engine").alias("e2"), of(2, "printable").alias("p2")).filter(F.col("e1").isNotNull())
    retry = ((F.col("dpi1") < 218) & (F.col("p1") < 48) & (F.coalesce("p2", F.lit(-1)) > F.col("p1"))
             & F.col("doc_id").isNotNull() & F.col("page").isNotNull())
    return both.select(
        *PAGE, F.when(retry, 2).otherwise(1).alias("ocr_pass"),
        F.when(retry, F.col("e2")).otherwise(F.col("e1")).alias("engine"))


CHOICE = [*PAGE, "ocr_pass", "engine"]


def choose_ocr_layer(words: DataFrame, **kw) -> DataFrame:
    """The words of the engine and pass chosen for each page."""
    return words.join(pick_pass(pick_engine(layer_stats(words), **kw)), CHOICE, "left_semi")


def merge_layers(ocr: DataFrame, native: DataFrame, *, iou_threshold: float = 0.32) -> DataFrame:
    """All OCR blocks and the native blocks no OCR block covers.

    A box that overlaps another with IoU >= t has its centre inside the other box widened by
    (0.5 - t) / t of its size on each side. So a native block looks only into the grid cell of its
    centre, and OCR boxes are listed in the cells they reach: one equality anti join, no pairs of a page.
    Equal OCR boxes of a cell are listed once, large boxes on a grid of their own, so a page-sized one stands in a few
    cells and not in every one of its page."""
    grow = max(0.0, (0.5 - iou_threshold) / iou_threshold) + 0.01
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    boxes = ocr.select(*PAGE, *BOX_COLS).distinct().withColumn(
        "_large", F.greatest(w, h) * (1 + 2 * grow) > F.lit(CELL * LARGE_CELLS))

    def uncovered(native: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
        def cells(lo: Column, hi: Column) -> Column:
            a, b = F.floor(lo / cell), F.floor(hi / cell)
            return F.sequence(a, F.greatest(a, b))

        listed = (boxes.withColumn("_cx", F.explode(cells(F.col("x0") - w * grow, F.col("x1") + w * grow)))
                  .withColumn("_cy", F.explode(cells(F.col("y0") - h * grow, F.col("y1") + h * grow)))
                  .select(*PAGE, "_cx", "_cy", geo.box_of().alias("o")))
        looked = (native.withColumn("_cx", F.floor((F.col("x0") + F.col("x1")) / 2 / cell))
                  .withColumn("_cy", F.floor((F.col("y0") + F.col("y1")) / 2 / cell)))
        n, o = looked.alias("n"), listed.alias("o")
        same = [F.col(f"n.{c}") == F.col(f"o.{c}") for c in (*PAGE, "_cx", "_cy")]
        nb = geo.box(*(F.col(f"n.{c}") for c in BOX_COLS))
        return n.join(o, [*same, geo.iou(nb, F.col("o.o")) >= iou_threshold], "left_anti").drop("_cx", "_cy")

    kept = uncovered(native, boxes.filter(~F.col("_large")), CELL)
    kept = uncovered(kept, boxes.filter("_large"), CELL * LARGE_CELLS ** 2)
    cols = ["doc_id", "page", "block_seq", "text", *BOX_COLS, "source"]
    return ocr.select(*cols).unionByName(kept.select(*cols))


def route_pages(native: DataFrame, words: DataFrame, *, aggressive: bool = True, mixed: bool = False,
                **kw) -> DataFrame:
    """The blocks of each page from the layer that serves it best, not yet in reading order.

    Aggressive: a weak page takes the chosen OCR layer, or its clean native blocks when OCR found none;
    other pages keep their clean native blocks (``mixed`` merges OCR into them). Not aggressive: native
    blocks if there are any, else engine 1, else engine 2."""
    cols = ["doc_id", "page", "block_seq", "text", *BOX_COLS, "source"]
    if not aggressive:
        first = words.filter((F.col("engine") == 1) & (F.col("ocr_pass") == 1))
        second = words.filter((F.col("engine") == 2) & (F.col("ocr_pass") == 1))
        pages = lambda d: d.select(*PAGE).distinct()
        one = first.join(pages(native), PAGE, "left_anti")
        two = second.join(pages(native), PAGE, "left_anti").join(pages(first), PAGE, "left_anti")
        return native.select(*cols).unionByName(one.select(*cols)).unionByName(two.select(*cols))
    clean = drop_stamps(native)
    strong = page_needs_ocr(native).filter(~F.col("weak")).select(*PAGE)
    # A page's choice has words, so its row tells that OCR found some without a look at the words.
    choice = pick_pass(pick_engine(layer_stats(words), **kw))
    if not mixed:
        taken = choice.join(strong, PAGE, "left_anti")
        ocr, kept = words.join(taken, CHOICE, "left_semi"), clean.join(taken, PAGE, "left_anti")
        return ocr.select(*cols).unionByName(kept.select(*cols))
    chosen = words.join(choice, CHOICE, "left_semi")
    weak_native = clean.join(strong, PAGE, "left_anti").join(choice, PAGE, "left_anti")
    merged = merge_layers(chosen.join(strong, PAGE, "left_semi"), clean.join(strong, PAGE, "left_semi"))
    weak_ocr = chosen.join(strong, PAGE, "left_anti")
    return weak_ocr.select(*cols).unionByName(weak_native.select(*cols)).unionByName(merged.select(*cols))
