"""Ticket triage from nearest neighbours: recommendation, categorisation,
one-pass triage.

Each function searches once for all queries and derives its result with
grouped aggregates and per-query windows.  Evidence lists are bounded
(``row_number() <= n`` before ``collect_list``), so no group collects an
unbounded list.  Every query gets a row: queries with nothing found are
kept by a left join and carry the documented defaults.

The query frame is read more than once (the bounded collect of the
search, and the left joins that keep every query); when it is expensive
to compute (embedding many texts), persist it first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectriage.functions.bands import confidence_band
from vectriage.functions.numeric import round_half_away
from vectriage.functions.timefn import ts_ntz
from vectriage.operators.search import search, similarity_pct

# The recommendation weights (frequency, satisfaction,
# similarity) of the two published forms.
WEIGHTS_V1 = (0.3, 15.0, 0.5)
WEIGHTS_V2 = (0.4, 20.0, 0.4)

TICKET_PAYLOAD = ["title", "category", "priority", "status", "resolution", "satisfaction_score",
                  "resolution_time_hours"]


def _top_n(df: DataFrame, part, order, n: int, name: str = "_rn") -> DataFrame:
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def _pct_units(distance: Column, digits: int) -> Column:
    """similarity_pct * 10^digits as an exact integer (sums of it are exact)."""
    raw = (F.lit(1.0) - distance) * F.lit(100.0)
    return (F.signum(raw) * F.floor(F.abs(raw) * F.lit(float(10 ** digits)) + F.lit(0.5))).cast("long")


def _avg_units(units: Column, n: Column, digits: int) -> Column:
    return F.sum(units).cast("double") / (n.cast("double") * F.lit(float(10 ** digits)))


def _evidence(df: DataFrame, part: list[str], sim_col: str, n: int, cols: list[str]) -> DataFrame:
    """Best n rows per group as a sorted array of structs (similarity desc, id)."""
    top = _top_n(df, part, [F.desc(sim_col), "ticket_id"], n)
    item = F.struct(F.col("_rn").alias("pos"), *[F.col(c) for c in cols])
    return (top.groupBy(*part).agg(F.array_sort(F.collect_list(item)).alias("_ev"))
               .withColumn("_ev", F.transform("_ev", lambda s: s.dropFields("pos"))))


def recommend(base: DataFrame, queries: DataFrame, k: int = 20, *, min_satisfaction: int = 4,
              max_distance: float | None = 0.30, weights=WEIGHTS_V1, sim_digits: int = 2,
              avg_digits: int = 2, top_n: int = 1, n_examples: int = 3, neighbors: DataFrame = None,
              **opts) -> DataFrame:
    """Best resolution(s) per query from similar resolved, well-rated tickets.

    ``confidence_score = (frequency*w1 + avg_satisfaction*w2 + avg_similarity*w3)
    / (max(avg_resolution_time, 1) * 0.1)``; it is not bounded to 100.  When
    every matched ticket lacks a resolution time the score is null and the
    resolution sorts last.  Queries with no match get one row with a null
    resolution, confidence 0.0, frequency 0 and an empty example list.
    """
    nn = neighbors if neighbors is not None else search(base, queries, k, payload=TICKET_PAYLOAD, **opts)
    nn = nn.where(F.col("rank") <= k)
    cond = ((F.col("status") == "resolved") & F.col("resolution").isNotNull()
            & (F.col("satisfaction_score") >= min_satisfaction))
    if max_distance is not None:
        cond = cond & (F.col("distance") < max_distance)
    sim = (nn.where(cond)
             .withColumn("similarity_pct", similarity_pct(F.col("distance"), digits=sim_digits))
             .withColumn("_units", _pct_units(F.col("distance"), sim_digits)))
    w1, w2, w3 = weights
    n = F.count(F.lit(1))
    groups = sim.groupBy("query_id", "resolution").agg(
        n.cast("long").alias("frequency"),
        (F.sum("satisfaction_score").cast("double") / n.cast("double")).alias("_avg_sat"),
        F.avg("resolution_time_hours").alias("_avg_time"),
        _avg_units(F.col("_units"), n, sim_digits).alias("_avg_sim"),
    )
    score = ((F.col("frequency") * F.lit(w1) + F.col("_avg_sat") * F.lit(w2) + F.col("_avg_sim") * F.lit(w3))
             / (F.greatest(F.col("_avg_time"), F.lit(1.0)) * F.lit(0.1)))
    groups = groups.select(
        "query_id", "resolution", "frequency",
        round_half_away("_avg_sat", avg_digits).alias("avg_satisfaction"),
        round_half_away("_avg_time", avg_digits).alias("avg_resolution_hours"),
        round_half_away("_avg_sim", avg_digits).alias("avg_similarity_pct"),
        F.when(F.col("_avg_time").isNotNull(), round_half_away(score, 2)).alias("confidence_score"),
    )
    best = _top_n(groups, ["query_id"],
                  [F.desc_nulls_last("confidence_score"), F.desc("frequency"), "resolution"], top_n,
                  "solution_rank")
    ev = _evidence(sim, ["query_id", "resolution"], "similarity_pct", n_examples,
                   ["ticket_id", "title", "similarity_pct"])
    best = best.join(ev, ["query_id", "resolution"], "left")
    out = queries.select("query_id").join(best, "query_id", "left")
    return out.select(
        "query_id",
        F.coalesce("solution_rank", F.lit(1)).cast("long").alias("solution_rank"),
        "resolution",
        F.coalesce("frequency", F.lit(0)).cast("long").alias("frequency"),
        "avg_satisfaction", "avg_resolution_hours", "avg_similarity_pct",
        F.when(F.col("resolution").isNull(), F.lit(0.0)).otherwise(F.col("confidence_score"))
         .alias("confidence_score"),
        F.coalesce(F.col("_ev"), F.array().cast(out.schema["_ev"].dataType)).alias("example_tickets"),
    )


def categorize(base: DataFrame, queries: DataFrame, k: int = 10, *, denominator: str = "total",
               neighbors: DataFrame = None, **opts) -> DataFrame:
    """Majority category and priority among the k nearest tickets.

    ``category_confidence`` = votes * 100 / number of neighbours found
    (``denominator='top_k'`` divides by k instead).  Queries with no
    neighbour get 'Unknown' / 'medium' and zeros.
    """
    nn = neighbors if neighbors is not None else search(base, queries, k, payload=["category", "priority"], **opts)
    nn = (nn.where(F.col("rank") <= k)
            .withColumn("_units", _pct_units(F.col("distance"), 2)))
    n = F.count(F.lit(1))
    total = F.sum("votes").over(Window.partitionBy("query_id"))
    den = F.lit(float(k)) if denominator == "top_k" else total.cast("double")
    cat = (nn.groupBy("query_id", "category").agg(n.cast("long").alias("votes"),
                                                  _avg_units(F.col("_units"), n, 2).alias("_avg"))
             .withColumn("category_confidence", round_half_away(F.col("votes") * F.lit(100.0) / den, 2))
             .withColumn("category_similarity", round_half_away("_avg", 2)))
    cat = _top_n(cat, ["query_id"], [F.desc("votes"), F.desc("category_similarity"), "category"], 1)
    pri = (nn.groupBy("query_id", "priority").agg(n.cast("long").alias("priority_votes"),
                                                  _avg_units(F.col("_units"), n, 2).alias("_avg"))
             .withColumn("priority_similarity", round_half_away("_avg", 2)))
    pri = _top_n(pri, ["query_id"], [F.desc("priority_votes"), F.desc("priority_similarity"), "priority"], 1)
    out = (queries.select("query_id")
           .join(cat.select("query_id", "category", F.col("votes").alias("category_votes"),
                            "category_similarity", "category_confidence"), "query_id", "left")
           .join(pri.select("query_id", "priority", "priority_votes", "priority_similarity"),
                 "query_id", "left"))
    return out.select(
        "query_id",
        F.coalesce("category", F.lit("Unknown")).alias("category"),
        F.coalesce("category_votes", F.lit(0)).cast("long").alias("category_votes"),
        F.coalesce("category_similarity", F.lit(0.0)).alias("category_similarity"),
        F.coalesce("category_confidence", F.lit(0.0)).alias("category_confidence"),
        F.coalesce("priority", F.lit("medium")).alias("priority"),
        F.coalesce("priority_votes", F.lit(0)).cast("long").alias("priority_votes"),
        F.coalesce("priority_similarity", F.lit(0.0)).alias("priority_similarity"),
    )


def category_votes(base: DataFrame, queries: DataFrame, k: int = 10, top_n: int = 3, **opts) -> DataFrame:
    """Votes per category among the k nearest, with the share of all votes;
    the ``top_n`` best categories per query."""
    nn = search(base, queries, k, payload=["category"], **opts)
    n = F.count(F.lit(1))
    votes = nn.groupBy("query_id", "category").agg(
        n.cast("long").alias("vote_count"),
        round_half_away(F.avg(F.lit(1.0) - F.col("distance")) * F.lit(100.0), 2).alias("avg_similarity_pct"))
    total = F.sum("vote_count").over(Window.partitionBy("query_id"))
    votes = votes.withColumn("confidence_pct",
                             round_half_away(F.col("vote_count") * F.lit(100.0) / total.cast("double"), 2))
    return (_top_n(votes, ["query_id"], [F.desc("vote_count"), F.desc("avg_similarity_pct"), "category"],
                   top_n, "category_rank")
            .withColumn("category_rank", F.col("category_rank").cast("long")))


def _ranked(nn: DataFrame, k: int) -> DataFrame:
    """(query_id, _nn): the k nearest of each query in order, one array; the one place where a query's neighbours are gathered."""
    item = F.struct("rank", "ticket_id", *TICKET_PAYLOAD, "distance")
    return nn.where(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("_nn"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _rounded_average(units: Column, n: Column, digits: int, places: int) -> Column:
    return round_half_away(units.cast("double") / (n.cast("double") * F.lit(float(10 ** digits))), places)


def _best_vote(items: Column, field: str) -> Column:
    """(value, votes, similarity) of the most frequent value of ``field``: by votes, similarity, value."""
    def group(v):
        def scored(own):
            votes = F.size(own).cast("long")
            units = F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + _pct_units(x["distance"], 2))
            sim = _rounded_average(units, votes, 2, 2)
            return F.struct((-votes).alias("by_votes"), (-sim).alias("by_similarity"), v.alias("value"), votes.alias("votes"), sim.alias("similarity"))
        return _let(F.filter(items, lambda x: x[field].eqNullSafe(v)), scored)

    return F.array_min(F.transform(F.array_distinct(F.transform(items, lambda x: x[field])), group))


def _best_solution(items: Column, min_satisfaction: int, max_distance: float | None, weights, digits: int, n_examples: int) -> Column:
    """The best resolution among ``items`` as ``recommend`` ranks them, with its figures and examples; null without one."""
    w1, w2, w3 = weights

    def useful(x):
        ok = (x["status"] == "resolved") & x["resolution"].isNotNull() & (x["satisfaction_score"] >= min_satisfaction)
        return F.coalesce(ok if max_distance is None else ok & (x["distance"] < max_distance), F.lit(False))

    def group(found, v):
        def scored(own):
            n = F.size(own).cast("long")
            total = lambda c, zero: F.aggregate(
                own, F.lit(zero).cast("long" if isinstance(zero, int) else "double"), lambda a, x: a + c(x))
            sat = total(lambda x: x["satisfaction_score"].cast("long"), 0).cast("double") / n.cast("double")
            timed = F.size(F.filter(own, lambda x: x["resolution_time_hours"].isNotNull()))
            hours = F.when(timed > 0, total(lambda x: F.coalesce(x["resolution_time_hours"], F.lit(0.0)), 0.0) / timed.cast("double"))
            sim = total(lambda x: _pct_units(x["distance"], digits), 0).cast("double") / (n.cast("double") * F.lit(float(10 ** digits)))
            score = (n * F.lit(w1) + sat * F.lit(w2) + sim * F.lit(w3)) / (F.greatest(hours, F.lit(1.0)) * F.lit(0.1))
            confidence = F.when(hours.isNotNull(), round_half_away(score, 2))
            examples = F.slice(F.array_sort(F.transform(own, lambda x: F.struct(
                (-similarity_pct(x["distance"], digits=digits)).alias("order"), x["ticket_id"].alias("ticket_id"), x["title"].alias("title"),
                similarity_pct(x["distance"], digits=digits).alias("similarity_pct")))), 1, n_examples)
            return F.struct(confidence.isNull().alias("last"), (-confidence).alias("by_confidence"), (-n).alias("by_frequency"), v.alias("resolution"),
                            n.alias("frequency"), round_half_away(sat, 2).alias("avg_satisfaction"), round_half_away(hours, 2).alias("avg_resolution_hours"),
                            round_half_away(sim, 2).alias("avg_similarity_pct"), confidence.alias("confidence"),
                            F.transform(examples, lambda x: x.dropFields("order")).alias("example_tickets"))
        return _let(F.filter(found, lambda x: x["resolution"] == v), scored)

    return _let(F.filter(items, useful), lambda found: F.array_min(
        F.transform(F.array_distinct(F.transform(found, lambda x: x["resolution"])), lambda v: group(found, v))))


def triage(base: DataFrame, queries: DataFrame, *, similar_k: int = 5, categorize_k: int = 10,
           recommend_k: int = 20, include_recommendations: bool = True, **opts) -> DataFrame:
    """Similar tickets, categorisation and recommendation for every query
    from one search at the largest k (instead of three searches per query).

    The neighbours of a query are gathered once, in one array of at most the
    largest k, and each of the three takes its own first ones from it, so the
    plan holds the search once.

    One row per query: ``similar_tickets`` (array of structs),
    categorisation columns, recommendation columns, and ``error`` (null
    unless the query's vector cannot be searched: missing, not finite, zero,
    or not ``dim`` wide).
    """
    from vectriage.operators.ivf import _usable

    kmax = max(similar_k, categorize_k, recommend_k if include_recommendations else 0)
    nn = search(base, queries, kmax, payload=TICKET_PAYLOAD, **opts)
    fits = _usable("embedding", opts.get("metric", "cosine"))
    if opts.get("dim"):
        fits = fits & (F.size("embedding") == opts["dim"])
    every = queries.select("query_id", (~F.coalesce(fits, F.lit(False))).alias("_noq"))
    out = every.join(_ranked(nn, kmax), "query_id", "left")
    first = lambda k: F.filter(F.coalesce("_nn", F.array().cast(out.schema["_nn"].dataType)), lambda x: x["rank"] <= k)
    near = first(categorize_k)
    cols = {
        "similar_tickets": F.transform(first(similar_k), lambda x: F.struct(x["rank"].alias("rank"), x["ticket_id"].alias("ticket_id"),
                                       x["title"].alias("title"), similarity_pct(x["distance"]).alias("similarity_score"))),
        "_cat": _best_vote(near, "category"), "_pri": _best_vote(near, "priority"), "_votes": F.size(near).cast("double"),
    }
    if include_recommendations:
        cols["_sol"] = _best_solution(first(recommend_k), 4, 0.30, WEIGHTS_V1, 2, 3)
    out = out.withColumns(cols)
    zero = lambda c, z: F.coalesce(F.col(c), F.lit(z))
    done = [
        "query_id", "similar_tickets",
        zero("_cat.value", "Unknown").alias("category"), zero("_cat.votes", 0).cast("long").alias("category_votes"),
        zero("_cat.similarity", 0.0).alias("category_similarity"),
        F.coalesce(round_half_away(F.col("_cat.votes") * F.lit(100.0) / F.col("_votes"), 2), F.lit(0.0)).alias("category_confidence"),
        zero("_pri.value", "medium").alias("priority"), zero("_pri.votes", 0).cast("long").alias("priority_votes"),
        zero("_pri.similarity", 0.0).alias("priority_similarity"),
    ]
    if include_recommendations:
        examples = out.schema["_sol"].dataType["example_tickets"].dataType
        done += [
            F.col("_sol.resolution").alias("solution"),
            F.when(F.col("_sol.resolution").isNull(), F.lit(0.0)).otherwise(F.col("_sol.confidence")).alias("confidence"),
            zero("_sol.frequency", 0).cast("long").alias("similar_ticket_count"),
            F.col("_sol.avg_satisfaction").alias("avg_satisfaction"), F.col("_sol.avg_resolution_hours").alias("avg_resolution_hours"),
            F.col("_sol.avg_similarity_pct").alias("avg_similarity_pct"),
            F.coalesce("_sol.example_tickets", F.array().cast(examples)).alias("example_tickets"),
        ]
    return out.select(*done, F.when(F.col("_noq"), F.lit("query has no usable embedding")).alias("error"))


def triage_summary(triaged: DataFrame) -> DataFrame:
    """Routing decision per triaged query."""
    has = F.col("solution").isNotNull()
    return triaged.select(
        "query_id",
        F.when(has, "auto-resolve").otherwise("manual review").alias("action"),
        F.concat(F.col("category"), F.lit(" team")).alias("route_to"),
        "priority",
        "solution",
        F.when(has, F.col("confidence")).alias("confidence"),
        F.when(has, confidence_band(F.col("confidence"))).alias("confidence_band"),
    )


def triage_one_pass(base: DataFrame, queries: DataFrame, as_of, *, k: int = 20,
                    min_similarity: float = 0.70, min_satisfaction: int = 4,
                    n_examples: int = 5, **opts) -> DataFrame:
    """Category, best solution by frequency / satisfaction / time, and the
    five most similar tickets, in one result row per query."""
    nn = search(base, queries, k, payload=TICKET_PAYLOAD, **opts)
    sim = (nn.where((F.lit(1.0) - F.col("distance")) >= min_similarity)
             .withColumn("similarity_score", similarity_pct(F.col("distance"), digits=1))
             .withColumn("_units", _pct_units(F.col("distance"), 1)))
    n = F.count(F.lit(1))
    cat = (sim.groupBy("query_id", "category").agg(n.cast("long").alias("votes"),
                                                   _avg_units(F.col("_units"), n, 1).alias("_avg"))
              .withColumn("avg_similarity", round_half_away("_avg", 1)))
    cat = _top_n(cat, ["query_id"], [F.desc("votes"), F.desc("avg_similarity"), "category"], 1)
    sol = (sim.where((F.col("status") == "resolved") & F.col("resolution").isNotNull()
                     & (F.col("satisfaction_score") >= min_satisfaction))
              .groupBy("query_id", "resolution").agg(
                  n.cast("long").alias("frequency"),
                  (F.sum("satisfaction_score").cast("double") / n.cast("double")).alias("_sat"),
                  F.avg("resolution_time_hours").alias("_time")))
    sol = _top_n(sol, ["query_id"], [F.desc("frequency"), F.desc("_sat"), F.asc_nulls_last("_time"),
                                     "resolution"], 1)
    ev = _evidence(sim, ["query_id"], "similarity_score", n_examples,
                   ["ticket_id", "title", "similarity_score"])
    out = (queries.select("query_id")
           .join(cat.select("query_id", F.col("category").alias("suggested_category"),
                            F.col("votes").alias("category_confidence_votes")), "query_id", "left")
           .join(sol.select("query_id", F.col("resolution").alias("recommended_solution"),
                            F.col("frequency").alias("solution_frequency"),
                            round_half_away("_sat", 1).alias("solution_satisfaction"),
                            round_half_away("_time", 1).alias("solution_avg_hours")), "query_id", "left")
           .join(ev, "query_id", "left"))
    return (out.withColumn("similar_historical_tickets", F.coalesce("_ev", F.array().cast(
                out.schema["_ev"].dataType)))
               .drop("_ev")
               .withColumn("triage_timestamp", ts_ntz(as_of)))
