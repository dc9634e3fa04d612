"""Constraints over the edges of a graph: unique objects, spouses, duplicate and contradicting statements."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from storyproof.config import Logic
from storyproof.functions import lexicon
from storyproof.functions.text import negated, token_set
from storyproof.operators import verify
from storyproof.schemas import VIOLATION
from storyproof.sources.store import materialize

SOLVER = "claim_nli_rule_engine_v1"
#: Statements of an id that are compared with as many others in one group, and the tokens that they have.
TILE, TOKENS = 1000, 1_000_000


def violation(rule: Column, triples: Column, confidence: Column, severity: str) -> Column:
    return F.struct(rule.alias("rule"), triples.alias("supporting_triples"), F.round(confidence, 4).alias("confidence"), F.lit(severity).alias("severity")).cast(VIOLATION)


def several_objects(edges: DataFrame, relations: tuple[str, ...], rule: Column, severity: str) -> DataFrame:
    """(id, violation) of ids with two or more distinct objects of one of some relations p; edges (id, triple_id, p, o, confidence)."""
    few = edges.where(F.col("p").isin(*relations)).groupBy("id", "p").agg(F.count_distinct(F.coalesce("o", F.lit(""))).alias("n"), F.max("confidence").alias("c"), F.array_sort(F.collect_list("triple_id")).alias("t"))
    return few.where("n >= 2").select("id", violation(rule, F.col("t"), F.col("c"), severity).alias("violation"))


def structural(edges: DataFrame) -> DataFrame:
    unique = F.concat(F.lit("Unique"), F.col("p"), F.lit("(A): cannot have multiple distinct "), F.col("p"), F.lit(" objects"))
    spouse = F.lit("MarriedTo(A,B) and MarriedTo(A,C) with B!=C (unless time-bucketed non-overlapping)")
    return several_objects(edges, lexicon.UNIQUE_RELATIONS, unique, "HARD").unionByName(several_objects(edges, ("MarriedTo",), spouse, "SOFT"))


def stated(triples: DataFrame) -> DataFrame:
    """The statements that are compared: objects of supported claims. Triples without a label of support count as supported."""
    supported = F.col("support_label") == "SUPPORT" if "support_label" in triples.columns else F.lit(True)
    return triples.where((F.col("p") == "Claim") & supported).select("id", F.col("triple_id").alias("pos"), "triple_id", F.col("o").alias("text"), "confidence")


def candidate_pairs(statements: DataFrame, cfg: Logic | None = None, keep: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """Pairs i < j of statements (id, pos, text) of one id that share enough tokens: id, i, j, shared, jaccard, unlike.

    Pairs are kept from a Jaccard similarity of min_jaccard on, from 0.6 of it where just one of the two is negated. Of each id
    the max_pairs with most shared tokens are kept, ties by i and j. That number is a bound, too: of an id with more statements
    than a tile holds, the largest token sets are compared first. Once max_pairs of them share so many tokens, smaller sets than
    that can be in no better pair and are left out. Tokens are compared by 64-bit hashes. Statements without id or pos are in no pair.
    """
    cfg = cfg or Logic()
    told = statements.where("id is not null and pos is not null").select("id", "pos", token_set(F.col("text")).alias("_tokens"))
    sets = told.select("id", "pos", negated(F.col("_tokens")).alias("negated"), F.transform("_tokens", lambda t: F.xxhash64(t)).alias("tokens")).withColumn("n", F.size("tokens"))
    sizes = keep(sets.groupBy("id", "n").agg(F.count(F.lit(1)).alias("c")), "set-sizes")
    downwards = Window.partitionBy("id").orderBy(F.desc("n"))
    held = sizes.withColumn("rows", F.sum("c").over(downwards)).withColumn("words", F.sum(F.col("c") * F.col("n")).over(downwards))
    fits = (F.col("rows") <= TILE) & (F.col("words") <= TOKENS)
    # how large a set must be to be among the first, and, where too many are as large as the largest, which share of those is
    shares = F.max(F.when(F.col("n") == F.col("top"), F.ceil(F.greatest(F.col("rows") / TILE, F.col("words") / TOKENS))))
    first = held.withColumn("top", F.max("n").over(Window.partitionBy("id"))).groupBy("id").agg(F.bool_and(fits).alias("all"), F.coalesce(F.min(F.when(fits, F.col("n"))), F.max("n")).alias("least"), shares.alias("shares"))
    first = keep(first.where("not all").select("id", "least", "shares"), "first-sets")
    bound, kept = sizes.select("id").distinct().withColumn("bound", F.lit(0).cast("long")), sets
    if not first.isEmpty():
        some = sets.join(first, "id").where((F.col("n") >= F.col("least")) & (F.pmod(F.xxhash64("pos"), F.col("shares")) == 0)).drop("n", "least", "shares")
        best = _pairs(some.withColumns({"a": F.lit(0), "b": F.lit(0), "own": F.lit(0)}), cfg)
        best = best.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("shared").alias("bound")).where(F.col("n") == cfg.max_pairs).select("id", "bound")
        bound = keep(bound.drop("bound").join(best, "id", "left").na.fill(0, ["bound"]), "bounds")
        kept = sets.join(bound, "id").where("n >= bound").drop("bound")
    left = sizes.join(bound, "id").where("n >= bound").groupBy("id")
    tiles = keep(left.agg(F.greatest(F.ceil(F.sum("c") / TILE), F.ceil(F.sum(F.col("c") * F.col("n")) / TOKENS)).cast("int").alias("_tiles")), "tiles")
    own = kept.join(tiles, "id").withColumn("own", F.pmod(F.xxhash64("pos"), F.col("_tiles")).cast("int"))
    dealt = own.withColumn("_other", F.explode(F.when(F.col("_tiles") > 0, F.sequence(F.lit(0), F.col("_tiles") - 1))))
    near = _pairs(dealt.select("id", F.least("own", "_other").alias("a"), F.greatest("own", "_other").alias("b"), "own", "pos", "negated", "tokens"), cfg)
    nth = Window.partitionBy("id").orderBy(F.desc("shared"), "i", "j")
    return near.withColumn("_n", F.row_number().over(nth)).where(F.col("_n") <= cfg.max_pairs).drop("_n")


def _pairs(groups: DataFrame, cfg: Logic) -> DataFrame:
    """The max_pairs best pairs of each group (id, a, b) of rows with own (a or b), pos, negated, tokens: of the two tiles a and b, or within one.

    One statement after the other adds up what it shares with those of the other tile in one dense array, token by token over
    the lists of statements that have it, so only pairs that are kept become rows. Groups are bounded by TILE and TOKENS.
    """
    most, least, enough, floor = cfg.max_pairs, cfg.min_jaccard * 0.6, cfg.min_jaccard, cfg.min_shared_tokens

    def of_tiles(rows: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        pos, lists = rows.column("pos").combine_chunks(), rows.column("tokens").combine_chunks()
        order = pc.rank(pos, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)
        own, negated = rows.column("own").to_numpy(), rows.column("negated").to_numpy(zero_copy_only=False).astype(bool)
        n = lists.value_lengths().to_numpy().astype(np.int64)
        token = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        ends = np.cumsum(n)
        twice = rows.column("a")[0].as_py() == rows.column("b")[0].as_py()
        first = np.ones(len(n), dtype=bool) if twice else own == own.min()
        second = np.flatnonzero(np.ones(len(n), dtype=bool) if twice else ~first)
        has = np.repeat(np.arange(len(n)), n)
        held = np.isin(has, second)
        by_token = np.flatnonzero(held)[np.argsort(token[held], kind="stable")]
        start = np.concatenate([[0], np.cumsum(np.bincount(token[held], minlength=token.max(initial=-1) + 1))])
        kept = [np.zeros((5, 0))]

        def best(found: list[np.ndarray]) -> np.ndarray:
            joined = np.concatenate(found, axis=1)
            return joined[:, np.lexsort([joined[1], joined[0], -joined[2]])[:most]]

        for x in np.flatnonzero(first).tolist():
            mine = token[ends[x] - n[x] : ends[x]]
            size = start[mine + 1] - start[mine]
            at = np.repeat(start[mine] - np.cumsum(size) + size, size) + np.arange(size.sum())
            shared = np.bincount(has[by_token[at]], minlength=len(n))
            some = np.flatnonzero((shared >= max(1, floor)) & ((order > order[x]) if twice else (order != order[x])))
            jaccard = shared[some] / (n[x] + n[some] - shared[some])
            unlike = negated[some] != negated[x]
            near = (jaccard >= enough) | (unlike & (jaccard >= least))
            some, low = some[near], order[some[near]] < order[x]
            places = np.where(low, some, x), np.where(low, x, some)
            kept.append(np.stack([order[places[0]], order[places[1]], shared[some], jaccard[near], unlike[near]]))
            if sum(k.shape[1] for k in kept) > 100_000:
                kept = [best(kept)]
        i, j, shared, jaccard, unlike = best(kept)
        value = np.zeros(order.max(initial=0) + 1, dtype=np.int64)
        value[order] = np.arange(len(order))
        ids = rows.column("id").combine_chunks().take(pa.array(np.zeros(len(i), dtype=np.int64)))
        named = [pos.take(pa.array(value[x.astype(np.int64)])) for x in (i, j)]
        return pa.table([ids, *named, pa.array(shared.astype(np.int64)), pa.array(jaccard), pa.array(unlike.astype(bool))], ["id", "i", "j", "shared", "jaccard", "unlike"])

    kind = {c: groups.schema[c].dataType for c in ("id", "pos")}
    schema = StructType([StructField("id", kind["id"]), StructField("i", kind["pos"]), StructField("j", kind["pos"]), StructField("shared", LongType()), StructField("jaccard", DoubleType()), StructField("unlike", BooleanType())])
    return groups.groupBy("id", "a", "b").applyInArrow(of_tiles, schema)


def lexical(pairs: DataFrame, statements: DataFrame, cfg: Logic | None = None) -> DataFrame:
    """(id, violation) of near-identical pairs and of pairs alike but for a negation; statements (id, pos, triple_id, confidence)."""
    cfg = cfg or Logic()
    of = lambda x: statements.select("id", F.col("pos").alias(x), F.col("triple_id").alias(f"t{x}"), F.col("confidence").alias(f"c{x}"))
    full = pairs.join(of("i"), ["id", "i"]).join(of("j"), ["id", "j"])
    triples = F.array_sort(F.array("ti", "tj"))
    same = violation(F.lit("DuplicateClaims(A): near-identical supported claims"), triples, F.greatest("ci", "cj"), "SOFT")
    against = violation(F.lit("ContradictoryClaims(A): lexical negation mismatch in otherwise similar claims"), triples, F.lit(0.65), "SOFT")
    found = F.when(F.col("jaccard") >= cfg.duplicate_jaccard, same).when(F.col("unlike") & (F.col("jaccard") >= 0.35), against)
    return full.select("id", found.alias("violation")).where("violation is not null")


def symmetric(judged: DataFrame) -> DataFrame:
    """For pairs judged in both directions (id, i, j, entail, contradict) the larger of each, by the unordered pair."""
    return judged.groupBy("id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.max("entail").alias("entail"), F.max("contradict").alias("contradict"))


def judged(pairs: DataFrame, statements: DataFrame, judge: Callable[[Column, Column], Column], known: str = "") -> DataFrame:
    """Pairs (id, i, j) judged in both directions: (id, i, j, entail, contradict), for statements (id, pos, text); known as in verify.judged()."""
    of = lambda x: statements.select("id", F.col("pos").alias(x), F.col("text").alias(f"text_{x}"))
    told = pairs.select("id", "i", "j").join(of("i"), ["id", "i"]).join(of("j"), ["id", "j"])
    both = told.select("id", "i", "j", F.inline(F.array(*(F.struct(F.col(f"text_{a}").alias("premise"), F.col(f"text_{b}").alias("hypothesis")) for a, b in ("ij", "ji")))))
    return verify.judged(both, judge, "premise", "hypothesis", known).select("id", "i", "j", "_j.entail", "_j.contradict")


def by_model(pairs: DataFrame, judged: DataFrame, statements: DataFrame, cfg: Logic | None = None) -> DataFrame:
    """(id, violation) from a model's probabilities: duplicates first, then hard, then soft contradictions."""
    cfg = cfg or Logic()
    of = lambda x: statements.select("id", F.col("pos").alias(x), F.col("triple_id").alias(f"t{x}"), F.col("confidence").alias(f"c{x}"))
    full = pairs.join(symmetric(judged), ["id", "i", "j"]).join(of("i"), ["id", "i"]).join(of("j"), ["id", "j"])
    triples, best = F.array_sort(F.array("ti", "tj")), F.greatest("ci", "cj")
    same = (F.col("jaccard") >= cfg.duplicate_jaccard) | ((F.col("entail") >= cfg.duplicate_entailment) & (F.col("contradict") < 0.2))
    hard = (F.col("contradict") >= cfg.hard_contradiction) & (F.col("contradict") >= F.col("entail") + cfg.margin)
    soft = (F.col("contradict") >= cfg.soft_contradiction) & ((F.col("jaccard") >= 0.30) | F.col("unlike"))
    found = (
        F.when(same, violation(F.lit("DuplicateClaims(A): near-identical supported claims"), triples, F.greatest(best, "entail"), "SOFT"))
        .when(hard, violation(F.lit("ContradictoryClaims(A): NLI contradiction between supported claims"), triples, 0.6 * F.col("contradict") + 0.4 * best, "HARD"))
        .when(soft, violation(F.lit("ContradictoryClaims(A): possible contradiction among similar supported claims"), triples, 0.5 * F.col("contradict") + 0.5 * best, "SOFT"))
    )
    return full.select("id", found.alias("violation")).where("violation is not null")


def constraints(ids: DataFrame, violations: DataFrame, edges: DataFrame, run_id: str = "") -> DataFrame:
    """The constraint table: status, violations, and the triples behind it; without violations the three best triples."""
    hard = F.bool_or(F.col("violation.severity") == "HARD")
    found = violations.groupBy("id").agg(F.array_sort(F.collect_list("violation")).alias("violations"), hard.alias("_hard"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("violation.supporting_triples")))).alias("_triples"), F.max("violation.confidence").alias("_confidence"))
    order = Window.partitionBy("id").orderBy(F.desc("confidence"), "triple_id")
    best = edges.withColumn("_n", F.row_number().over(order)).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= 3, F.struct("_n", "triple_id")))), lambda x: x["triple_id"]).alias("_best"), F.max("confidence").alias("_most"))
    joined = ids.select("id").distinct().join(found, "id", "left").join(best, "id", "left")
    empty = F.array().cast("array<string>")
    return joined.select(
        "id", F.when(F.col("_hard"), F.lit("UNSAT")).when(F.col("_hard").isNotNull(), F.lit("SOFT_VIOLATIONS")).otherwise(F.lit("SAT")).alias("status"),
        F.coalesce("violations", F.array().cast(f"array<{VIOLATION}>")).alias("violations"), F.coalesce("_triples", "_best", empty).alias("supporting_triples"),
        F.round(F.coalesce("_confidence", "_most", F.lit(0.0)), 4).alias("confidence"), F.lit(SOLVER).alias("solver"), F.lit(run_id).alias("run_id"),
    )


def grounded(ids: DataFrame, run_id: str = "") -> DataFrame:
    """The catalogue of constraints, the same for every id."""
    rows = F.array(*(F.struct(F.lit(p).alias("predicate"), F.lit(t).alias("type"), F.lit(s).alias("severity")) for p, t, s in lexicon.GROUNDED))
    return ids.select("id").distinct().select("id", rows.alias("constraints"), F.lit(run_id).alias("run_id"))
