"""From detector reads to a decision: reproduction, zoom, blind spots, scores, lanes, rules, findings.

Tables: candidates (case_id, candidate_id, x0, y0, x1, y1, score, and flags as they are found), reads (case_id,
read_id, box, score), blindspots (case_id, box, score). Boxes are integers, a larger score is more suspicious.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.expr import box, center_inside, iou, near_center
from quillon.operators.boxes import EDGES, touching

#: Parameters of the default policy.
DEFAULTS = {
    "min_reproduced": 3, "max_zoom_crops": 8, "zoom_score_ratio": 0.4, "fp_max_aspect_ratio": 3.0, "blindspot_min_score": 0.55, "band_low": 0.35, "band_high": 0.65, "max_disagreement": 0.4, "fast_negative_max_score": 0.2,
    "fast_negative_requires_blindspot_clean": True, "llm_on_rule_deferral": True, "llm_on_conformal_ambiguous": True, "llm_max_fraction": 0.25, "student_min_confidence": None,
}


def quality_verdict(pixels: Column, flat: float = 0.05, bright: float = 0.999, most: float = 0.5) -> Column:
    """QC of an array of intensities: flat images are inadequate, mostly saturated ones degraded. No pixels, or null ones, are inadequate."""
    share = F.try_divide(F.size(F.filter(pixels, lambda p: p >= bright)), F.size(pixels))
    spread = F.array_max(pixels) - F.array_min(pixels)
    return F.when(spread.isNull() | (spread < flat), "inadequate_defer").when(share > most, "degraded").otherwise("adequate")


def reproduction(candidates: DataFrame, reads: DataFrame, n_reads: Column | int, overlap: float = 0.3, least: int = 3) -> DataFrame:
    """candidates with reproduced, reproduced_fraction and kept: in how many reads of the case some box overlaps.

    Boxes meet on a grid, equal ones of a case (and read) once. A candidate with a null edge is reproduced by none.
    """
    pairs = touching(candidates.select("case_id", *EDGES).distinct(), reads.select("case_id", "read_id", *EDGES).distinct(), ["case_id"]).where(iou(box("", "l"), box("", "r")) >= overlap)
    hit = pairs.groupBy("l").agg(F.count_distinct("r.read_id").alias("reproduced")).select("l.*", "reproduced")
    out = candidates.join(hit, ["case_id", *EDGES], "left").select(*candidates.columns, F.coalesce("reproduced", F.lit(0)).alias("reproduced"))
    n = F.lit(n_reads) if isinstance(n_reads, int) else n_reads
    return out.withColumn("reproduced_fraction", F.col("reproduced") / n).withColumn("kept", F.col("reproduced") >= least)


def zoom_budget(candidates: DataFrame, most: int = 8, order: str = "candidate_id") -> DataFrame:
    """candidates with zoomed: the first `most` kept ones of each case in proposal order."""
    place = F.row_number().over(Window.partitionBy("case_id", "kept").orderBy(order))
    return candidates.withColumn("zoomed", F.col("kept") & (place <= most))


def zoom_confirm(candidates: DataFrame, crops: DataFrame, ratio: float = 0.4) -> DataFrame:
    """candidates with zoom_confirmed and kept: a zoomed one needs a re-detection near the crop's center, scored well enough.

    crops: (case_id, candidate_id, width, height, box, score) of the detector on each crop.
    """
    c, z = candidates.where("zoomed").alias("c"), crops.alias("z")
    near = near_center(box("", "z"), F.col("z.width"), F.col("z.height")) & (F.col("z.score") >= ratio * F.col("c.score"))
    ok = c.join(z, (F.col("c.case_id") == F.col("z.case_id")) & (F.col("c.candidate_id") == F.col("z.candidate_id"))).where(near).select("c.case_id", "c.candidate_id", F.lit(True).alias("_ok")).distinct()
    out = candidates.join(ok, ["case_id", "candidate_id"], "left")
    confirmed = F.when(F.col("zoomed"), F.coalesce("_ok", F.lit(False))).otherwise(F.col("kept"))
    return out.withColumn("zoom_confirmed", confirmed).withColumn("kept", F.col("kept") & F.col("zoom_confirmed")).drop("_ok", "zoomed")


def veto(found: Column, reason: Column, aspect: Column, most: float = 3.0) -> Column:
    """Why a segmentation speaks against a candidate; null if it doesn't."""
    long = F.format_string("elongated background ridge, not a mass (aspect ratio %s > %s)", aspect.cast("string"), F.lit(str(most)))
    return F.when(~found, F.format_string("no coherent component at proposed location (%s)", reason)).when(aspect > most, long)


def unexamined(blindspots: DataFrame, examined: DataFrame, least: float = 0.55, overlap: float = 0.1) -> DataFrame:
    """Blind-spot boxes of enough score that no examined box of the case covers. Boxes meet on a grid, equal ones of a case once."""
    b = blindspots.where(F.col("score") >= least)
    pairs = touching(b.select("case_id", *EDGES).distinct(), examined.select("case_id", *EDGES).distinct(), ["case_id"])
    covered = center_inside(box("", "l"), box("", "r")) | (iou(box("", "l"), box("", "r")) > overlap)
    return b.join(pairs.where(covered).select("l.*").distinct(), ["case_id", *EDGES], "left_anti").select(*blindspots.columns)


def disagreement(reads: DataFrame, floor: float = 0.5) -> DataFrame:
    """(case_id, disagreement): 4 p (1 - p), p the share of reads with a box of that score."""
    per = reads.groupBy("case_id", "read_id").agg(F.max(F.when(F.col("score") >= floor, 1).otherwise(0)).alias("v")).groupBy("case_id").agg(F.avg("v").alias("p"))
    return per.select("case_id", (F.col("p") * (1 - F.col("p")) * 4).alias("disagreement"))


def case_score(candidates: DataFrame, head: str | None = None) -> DataFrame:
    """(case_id, case_score): the largest kept score, 0 without any; averaged with a head's score if given."""
    g = candidates.groupBy("case_id").agg(F.coalesce(F.max(F.when(F.col("kept"), F.col("score"))), F.lit(0.0)).alias("case_score"), *([F.first(head).alias("_h")] if head else []))
    return g.select("case_id", (F.col("case_score") * 0.5 + F.col("_h") * 0.5).alias("case_score")) if head else g


def lane(top: Column, blindspots: Column, most: float = 0.2, clean: bool = True) -> Column:
    """fast_negative if no candidate reaches the score and, where required, no blind spot is left."""
    fast = F.coalesce(top, F.lit(0.0)) < most
    return F.when(fast & (blindspots == 0) if clean else fast, "fast_negative").otherwise("routine")


def escalate(decision: Column, ambiguous: Column, blindspots: Column, on_deferral: bool = True, on_ambiguous: bool = True) -> Column:
    return (F.lit(on_deferral) & (decision == "defer_to_human")) | (F.lit(on_ambiguous) & ambiguous) | (blindspots > 0)


def assess(vetoed: Column, fraction: Column, confirmed: Column, score: Column) -> Column:
    """present, uncertain or absent; a candidate that was not zoomed counts as confirmed."""
    solid = (fraction >= 0.6) & F.coalesce(confirmed, F.lit(True))
    return F.when(vetoed, "absent").when(solid & (score >= 0.5), "present").when(solid, "uncertain").otherwise("absent")


def decide(qc: Column, disagreement: Column, score: Column, blindspots: Column, low: float = 0.35, high: float = 0.65, most: float = 0.4) -> Column:
    """The rules in order; the band's ends belong to it, and its upper end is the threshold of a recall."""
    return (
        F.when(qc == "inadequate_defer", "defer_to_human").when(disagreement > most, "defer_to_human")
        .when((score >= low) & (score <= high), "defer_to_human").when(score > high, "recall")
        .when(blindspots > 0, "defer_to_human").otherwise("no_recall")
    )


FEATURES = ["case_score", "disagreement_rate", "n_candidates", "n_kept", "n_vetoed", "max_candidate_score", "mean_reproduced_fraction", "n_blindspot", "qc_adequate"]


def features(cases: DataFrame, candidates: DataFrame, blindspots: DataFrame, digits: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """(case_id, FEATURES): the numbers a student sees. cases has case_id, case_score, disagreement and qc.

    The mean fraction is taken over decimals: sums of doubles depend on the order of rows, and a student's threshold may lie on a mean.
    With order, a total one within a case, it is the sum of doubles in that order over their number, which is what SQL's avg gives.
    """
    fraction, mean = F.col("reproduced_fraction"), F.avg(F.col("reproduced_fraction").cast("decimal(28,18)")).cast("double")
    if order is not None:
        # the running sum adds row by row; fractions aren't negative, so its last value is the largest
        candidates = candidates.withColumn("_sum", F.sum(fraction).over(Window.partitionBy("case_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        mean = F.max("_sum") / F.count(fraction)
    c = candidates.groupBy("case_id").agg(
        F.count("*").alias("n_candidates"), F.count_if(F.col("kept")).alias("n_kept"), F.count_if(F.col("vetoed")).alias("n_vetoed"),
        F.max("score").alias("top"), mean.alias("mean_reproduced"),
    )
    b = blindspots.groupBy("case_id").agg(F.count("*").alias("n_b"))
    out = cases.join(c, "case_id", "left").join(b, "case_id", "left")
    cut = (lambda x: F.round(x, digits)) if digits is not None else (lambda x: x)
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("double")
    return out.select(
        "case_id", cut(F.col("case_score")).alias(FEATURES[0]), cut(F.col("disagreement")).alias(FEATURES[1]), zero("n_candidates").alias(FEATURES[2]), zero("n_kept").alias(FEATURES[3]), zero("n_vetoed").alias(FEATURES[4]),
        cut(zero("top")).alias(FEATURES[5]), cut(zero("mean_reproduced")).alias(FEATURES[6]), zero("n_b").alias(FEATURES[7]), F.when(F.col("qc") == "adequate", 1.0).otherwise(0.0).alias(FEATURES[8]),
    )


def compact(candidates: DataFrame, top: int = 8) -> DataFrame:
    """(case_id, kept ids in order, omitted, max_omitted): the best `top` candidates of each case and a summary of the rest."""
    r = candidates.withColumn("rn", F.row_number().over(Window.partitionBy("case_id").orderBy(F.col("score").desc(), F.col("candidate_id").asc())))
    return r.groupBy("case_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= top, F.struct("rn", "candidate_id")))), lambda x: x["candidate_id"]).alias("ids"),
        F.count_if(F.col("rn") > top).alias("omitted"), F.max(F.when(F.col("rn") > top, F.col("score"))).alias("max_omitted"),
    )


def compact_request(cases: DataFrame, candidates: DataFrame, top: int = 8, keys: tuple[str, ...] = ("candidate_id", "score", "reproduced_fraction", "zoom_confirmed", "veto_reason")) -> DataFrame:
    """(case_id, request): JSON of a case with its best candidates; nulls are left out, numbers cut to 3 digits."""
    r = candidates.withColumn("rn", F.row_number().over(Window.partitionBy("case_id").orderBy(F.col("score").desc(), F.col("candidate_id").asc())))
    kinds = dict(r.dtypes)
    one = F.struct("rn", *((F.round(k, 3) if kinds[k] == "double" else F.col(k)).alias(k) for k in keys if k in kinds))
    g = r.groupBy("case_id").agg(F.array_sort(F.collect_list(F.when(F.col("rn") <= top, one))).alias("c"), F.count_if(F.col("rn") > top).alias("o"), F.max(F.when(F.col("rn") > top, F.round("score", 3))).alias("m"))
    out = cases.join(g, "case_id", "left")
    some = F.when(F.size("c") > 0, F.transform("c", lambda x: x.dropFields("rn")))
    head = F.struct("case_id", "qc", F.struct(F.round("case_score", 3).alias("case_score"), F.round("disagreement", 3).alias("disagreement_rate")).alias("consistency"), some.alias("candidates"), F.when(F.col("o") > 0, F.col("o")).alias("omitted_candidates"), F.col("m").alias("max_omitted_score"))
    return out.select("case_id", F.to_json(head).alias("request"))


def findings(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Kept candidates with the assessment their case's map gives them, uncertain by default."""
    j = candidates.where("kept").join(verdicts, "case_id", "left")
    return j.withColumn("assessment", F.coalesce(F.try_element_at("per_candidate", F.col("candidate_id").cast("string")), F.lit("uncertain"))).drop("per_candidate")
