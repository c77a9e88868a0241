"""Scores of postings for every role of a pack, and the best role."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnow.functions import terms
from winnow.operators.gates import flagged, known_of


def _whole(x: Column) -> Column:
    """Toward zero."""
    return x.cast("int")


def _matched(rows: DataFrame, pack) -> DataFrame:
    """Flagged rows with what each role's words match: whether, how many and (left out where it isn't shown) which. Each is
    looked for once, in generated code."""
    blob, title, told, out = F.col("_blob"), F.col("_title"), known_of(pack), {}  # told of the blob alone
    for i, r in enumerate(pack.roles):
        out |= {f"_strong{i}": terms.any_of(blob, r.titles_strong, told), f"_weak{i}": terms.any_of(blob, r.titles_weak, told), f"_senior{i}": terms.any_of(title, r.senior_terms)}
        for name, text, words, k in (("boost", blob, r.keywords_boost, told), ("bad", blob, r.keywords_penalize, told), ("lead", title, r.keywords_penalize_title, None)):
            out |= {f"_{name}{i}": terms.count(text, words, k), f"_{name}_hits{i}": terms.hits(text, words, k)}
    return rows.withColumns(out)


def _verdict(role, pack, order: int, reasons: bool = True) -> Column:
    """struct(role, ord, passed_gate, score, recommend, reasons) of one role from the flags and its matches."""
    w, c = pack.weights, F.col
    mine = lambda name: c(f"_{name}{order}")
    strong, boost, bad, bad_title = map(mine, ("strong", "boost", "bad", "lead"))
    capped = lambda n: F.greatest(n * w["penalize_each"], F.lit(w["penalize_cap"]))
    remote, onsite, ew = c("_remote") & ~c("_place"), c("_onsite") | c("_place"), role.english_weight
    outside = onsite & ~remote & ~c("_reloc")
    soft = lambda mode, key: F.when((c("_english") == mode) & F.lit(mode not in pack.english_gates), int(w[key] * ew))
    note = lambda text: F.lit(text)
    shown = lambda name, n: F.array_join(F.slice(mine(f"{name}_hits"), 1, n), ", ")
    signed = lambda x: F.when(x >= 0, F.concat(F.lit("+"), x.cast("string"))).otherwise(x.cast("string"))
    penalty = _whole(c("_penalties") * (w["english_penalty_each"] * ew))
    parts: list[tuple[Column, Column]] = [  # points (null: doesn't apply) and what is said of them
        (F.when(strong, w["title_strong"]).when(mine("weak"), w["title_weak"]), F.when(strong, "strong title").otherwise("related title")),
        (F.when(boost > 0, F.least(boost * w["boost_each"], F.lit(w["boost_cap"]))), F.concat(note("skills: "), shown("boost", 6))),
        (F.when(bad > 0, capped(bad)), F.concat(note("mismatches: "), shown("bad", 6))),
        (F.when(bad_title > 0, capped(bad_title)), F.concat(note("leading title: "), shown("lead", 4))),
        (F.when(~strong & mine("senior"), w["senior"]), note("senior")),
        (F.when(remote, w["remote"]), note("remote")),
        (F.when(c("_reloc"), w["relocation"]), note("relocation country")),
        (F.when(outside & c("_russian"), w["onsite_ru_desk"]).when(outside, w["onsite"]), F.when(c("_russian"), "office abroad, Russian-speaking").otherwise("office only")),
        (F.when(c("_penalties") > 0, penalty), F.concat(note("strong English: "), F.array_join(F.slice(c("_penalty"), 1, 4), ", "))),
        (F.when(c("_russian"), int(w["english_boost"] * ew)), note("Russian-speaking team")),
        (F.coalesce(soft("written", "english_written_only"), soft("level_b", "english_level_b"), soft("level_c", "english_level_c")), F.concat(note("English: "), c("_english"))),
        (F.when(c("_entry"), w["entry"]), note("entry level")),
        (F.when(c("_shift") == "occasional", w["night_shift_occasional"]).when(c("_shift") == "shift", w["shift_schedule"]), F.concat(note("shifts: "), c("_shift"))),
    ]
    reason = mine("reason")
    total = reduce(lambda a, b: a + b, [F.coalesce(p.cast("int"), F.lit(0)) for p, _ in parts], F.lit(w["gate_base"]))
    score = F.when(reason.isNotNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), total))).cast("int")
    told = F.array_compact(F.array(*[F.when(p.isNotNull(), F.concat(signed(p), F.lit(" "), t)) for p, t in parts]))
    said = [F.when(reason.isNotNull(), F.array(reason)).otherwise(told).alias("reasons")] if reasons else []
    return F.struct(
        F.lit(role.name).alias("role"), F.lit(order).alias("ord"), reason.isNull().alias("passed_gate"), score.alias("score"),
        (reason.isNull() & (score >= role.threshold)).alias("recommend"), *said,
    )


def spread(postings: DataFrame) -> DataFrame:
    """postings over all cores before the patterns run. An input of at least as many partitions, any large one, stays as it is."""
    cores = postings.sparkSession.sparkContext.defaultParallelism
    return postings if postings.rdd.getNumPartitions() >= cores else postings.repartition(cores)


def _unrolled(rows: DataFrame, keep: list[str], verdicts: list[Column]) -> DataFrame:
    """A row per verdict. They are found in a projection of their own, as a generator's expressions are interpreted; its array
    is made in place, as the optimizer tests one of a column for being empty, which finds all verdicts once more."""
    each = [f"_v{i}" for i in range(len(verdicts))]
    return rows.select(*keep, *map(Column.alias, verdicts, each)).select(*keep, F.explode(F.array(*each)).alias("v")).select(*keep, "v.*")


def verdicts(postings: DataFrame, pack, reasons: bool = True) -> DataFrame:
    """One row per posting and role: the posting's columns, role, ord, passed_gate, score, recommend, reasons (if asked for).

    Roles are unrolled in the plan: no join, no shuffle.
    """
    return _unrolled(_matched(flagged(postings, pack), pack), postings.columns, [_verdict(r, pack, i, reasons) for i, r in enumerate(pack.roles)])


def rejections(postings: DataFrame, pack) -> DataFrame:
    """As verdicts, of the gates alone, without scores: role, ord, passed_gate and, as reasons, the first that rejects."""
    told = lambda role, i, reason: F.struct(F.lit(role.name).alias("role"), F.lit(i).alias("ord"), reason.isNull().alias("passed_gate"), F.when(reason.isNull(), F.array().cast("array<string>")).otherwise(F.array(reason)).alias("reasons"))
    return _unrolled(flagged(postings, pack), postings.columns, [told(r, i, F.col(f"_reason{i}")) for i, r in enumerate(pack.roles)])


def best(postings: DataFrame, pack, reasons: bool = True) -> DataFrame:
    """One row per posting with its best verdict; the first role of the pack wins ties. No shuffle. Without reasons for
    reports of scores, which need none of the words that are shown."""
    keep = postings.columns
    # The generator keeps the optimizer from copying the verdicts into every filter that stands above.
    rows = _matched(flagged(postings, pack), pack).select(*keep, F.array(*[_verdict(r, pack, i, reasons) for i, r in enumerate(pack.roles)]).alias("_vs"))
    rows = rows.select(*keep, F.explode(F.array("_vs")).alias("vs"))
    top = F.array_max(F.transform("vs", lambda v: F.struct(v.score.alias("score"), (-v.ord).alias("o"))))
    return rows.select(*keep, F.get(F.col("vs"), -top.o).alias("v")).select(*keep, "v.*")


def best_of(rows: DataFrame, keys: list[str], gated_only: bool = False) -> DataFrame:
    """The best verdict per key of a verdict table; gated_only looks at passed gates alone."""
    if gated_only:
        rows = rows.where("passed_gate")
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "ord")))
    return ranked.where("_r = 1").drop("_r")
