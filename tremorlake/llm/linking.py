"""Connected groups of rows that share keys and pass a test, without all pairs of a group.

Rows that share a key are candidates. As long as they are few against the rows themselves, all of them
are tested. Where a group is large, each key first picks a leader, the row that shares most with others,
and only (leader, row) pairs are tested. Rows found linked form components, and pairs inside a component
need no test any more. In the end all pairs between different components are tested, so no link between
components is lost. Where a key still has many of them, the caller may find candidates by what rows have
that their key's leader has not: see ``differ``. With ``beside`` the keys come slice by slice, and links of one
slice spare the pairs of the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.common import components, passing, staged
from tremorlake.operators.sizing import broadcast_when_small


#: Leaders that a row is compared with in one round; it has no more than keys.
LEADERS = 3
#: Pairs for each row of a key up to which all are tested in the end, though there is a ``differ``.
CROWD = 8
#: Rows of keys in one slice, as far as ``SLICES`` slices will do; then a slice is that share of all rows.
SLICE, SLICES = 2_000_000, 4
#: Pairs of a slice beyond which each row's likeliest partner is tested before the others.
LIKELIEST = 200_000


def _with_payload(pairs: DataFrame, payload: DataFrame) -> DataFrame:
    """(a, b, shared) with every payload column as l_<name> and r_<name>."""
    left = payload.select(*(F.col(c).alias(f"l_{c}") for c in payload.columns))
    right = payload.select(*(F.col(c).alias(f"r_{c}") for c in payload.columns))
    return pairs.join(left, F.col("a") == F.col("l_node")).join(right, F.col("b") == F.col("r_node"))


def _grown(edges: DataFrame | None, found: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """The links with ``found`` added, and the components of all."""
    edges = keep(staged(found if edges is None else edges.union(found), "links"))
    return edges, None if edges.isEmpty() else keep(staged(components(edges), "roots"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The ``pairs`` between different components."""
    for side in ("a", "b"):
        known = roots.select(F.col("node").alias(f"{side}_of"), F.col("root").alias(f"{side}_root"))
        pairs = pairs.join(known, F.col(side) == F.col(f"{side}_of"), "left")
    return pairs.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b", "shared")


def _sliced(
    shared: DataFrame,
    beside: DataFrame,
    near: Callable[[], Column],
    verify: Callable[[DataFrame], DataFrame],
    edges: DataFrame | None,
    roots: DataFrame | None,
    slices: int,
) -> DataFrame | None:
    """``link``'s last round, one slice of the keys after the other: all pairs between the components known so far.

    Only one slice's rows and pairs are on disk at once. Where pairs are many, each row's likeliest partner, the one
    that shares most keys with it, is tested first; what these links join needs no further test.
    """
    small = [c for c in beside.columns if c != "node"]
    for place in range(slices):
        with passing() as keep:
            rows = shared.select("key", "node").where(F.pmod("key", F.lit(slices)) == place)
            rows = rows.join(beside.withColumnRenamed("node", "of"), F.col("node") == F.col("of")).drop("of")
            if roots is None:
                rows = rows.withColumn("comp", F.col("node"))
            else:
                known = roots.select(F.col("node").alias("of"), "root")
                rows = rows.join(known, F.col("node") == F.col("of"), "left").withColumn("comp", F.coalesce("root", "node")).drop("of", "root")
            rows = staged(rows, "members")
            left, right = (
                rows.select(F.col("node").alias(name), *(F.col(c).alias(f"{side}_{c}") for c in ("key", "comp", *small)))
                for name, side in (("a", "l"), ("b", "r"))
            )
            pairs = left.join(right, (F.col("l_key") == F.col("r_key")) & (F.col("l_comp") < F.col("r_comp")) & near())
            pairs = staged(pairs.groupBy("a", "b").agg(F.count("*").alias("shared")), "pairs")
            left = pairs.count()
            while left > LIKELIEST:
                top = pairs.groupBy("b").agg(F.max(F.struct("shared", (-F.col("a")).alias("minus"))).alias("top"))
                top = staged(top.select((-F.col("top.minus")).alias("a"), "b"), "likeliest")
                edges, roots = _grown(edges, verify(top).select("a", "b"), keep)
                pairs = pairs.join(top, ["a", "b"], "left_anti")
                pairs = staged(pairs if roots is None else _apart(pairs, roots), "pairs")
                tested, before, left = top.count(), left, pairs.count()
                if before - tested - left < tested:  # a round that spares fewer tests than it takes is the last
                    break
            rest = pairs.select("a", "b")
            edges, roots = _grown(edges, verify(rest).select("a", "b"), keep)
    return roots


def link(
    members: DataFrame | Callable[[], DataFrame],
    near: Callable[[], Column],
    verify: Callable[[DataFrame], DataFrame],
    payload: DataFrame | None = None,
    likely: Callable[[], Column] | None = None,
    spare: int = 100,
    differ: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None,
    beside: DataFrame | None = None,
    slices: int | None = None,
) -> DataFrame | None:
    """(node, root) of all rows with a link, root being the smallest node; None without any link.

    ``members`` has (key, node), each pair once, and small columns that ``near`` compares as l_<name> and
    r_<name> inside the join; a function that gives them may stage what goes once they are read. With a column n,
    the rows of the key, they are shared keys only and not counted again. ``likely`` compares the columns of ``payload``, one row per node, in the
    same way. Both hold for every true link; ``verify`` keeps the true links of (a, b). All candidates
    are tested at once when there are at most ``spare`` times as many as rows. ``differ`` takes (a, b, l_comp,
    r_comp) of leaders a and the rows b of their keys, and gives the true links among them and candidates (a, b):
    at least every true link between rows of one leader that are in different components or get there by these links.
    ``beside`` has the columns that ``near`` compares, one row per node, instead of ``members``: they meet the keys of the
    last round slice by slice (``slices``, found by the number of rows unless given), without ``payload`` and ``differ``.
    """
    with passing() as keep:
        members = members() if callable(members) else members
        small = [c for c in (members if beside is None else beside).columns if c not in ("key", "node", "n")]
        if "n" not in members.columns:
            counts = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("k"), "n")
            # Most keys stand alone, so the shared ones, measured, mostly fit beside the rows, which then stay where they are.
            counts = broadcast_when_small(staged(counts, "shared"), max_bytes=16 << 20)
            members = members.join(counts, F.col("key") == F.col("k")).drop("k")
        shared = keep(staged(members, "members"))
    edges = roots = leads = scores = before = None
    while True:
        with passing() as keep:
            now = opened = shared.withColumn("comp", F.col("node"))
            if roots is None:  # every row of a key is a component of its own
                mixed = shared.select(F.col("key").alias("k"), "n", F.col("n").alias("inside")).distinct()
                left, rows = shared.agg(F.sum(F.expr("(n - 1) / 2")), F.count("*")).first()
            else:
                known = roots.select(F.col("node").alias("of"), "root")
                now = shared.join(known, F.col("node") == F.col("of"), "left")
                now = staged(now.select(*shared.columns, F.coalesce("root", "node").alias("comp")), "members")
                parts = now.groupBy("key", "comp").agg(F.count("*").alias("n"))
                mixed = parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("inside"))
                mixed = staged(mixed.where("n * n > inside").select(F.col("key").alias("k"), "n", "inside"), "keys")
                left, rows = mixed.agg(F.sum(F.expr("(n * n - inside) / 2")), F.sum("n")).first()
                opened = now.join(mixed.select("k"), F.col("key") == F.col("k")).drop("k")
            if not left:
                return None if roots is None else keep(roots)
            opened = opened.drop("n")
            # A round of leaders that leaves more than half has nothing more to give.
            last = left <= spare * rows or before is not None and 2 * left > before
            before = left
            if last and beside is not None:
                roots = _sliced(shared, beside, near, verify, edges, roots, slices or min(SLICES, 1 + rows // SLICE))
                return roots if roots is None else keep(roots)
            if beside is not None:
                opened = opened.join(beside.withColumnRenamed("node", "of"), F.col("node") == F.col("of")).drop("of")
            if scores is None and (not last or differ is not None):
                scores = keep(staged(shared.groupBy("node").agg(F.sum("n").alias("score")), "scores"))
            links = met = None
            if last and differ is not None:
                crowded = mixed.where(F.expr(f"(n * n - inside) / 2 > {CROWD} * n")).select("k")
                crowd = opened.join(crowded, F.col("key") == F.col("k")).drop("k")
                opened = opened.join(crowded, F.col("key") == F.col("k"), "left_anti")
                lead = F.max(F.struct("score", (-F.col("node")).alias("minus"), "comp")).alias("lead")
                best = crowd.join(scores, "node").groupBy("key").agg(lead).select(F.col("key").alias("l_key"), "lead")
                asked = crowd.join(best, F.col("key") == F.col("l_key"))
                asked = asked.select((-F.col("lead.minus")).alias("a"), F.col("node").alias("b"), F.col("lead.comp").alias("l_comp"), F.col("comp").alias("r_comp"))
                links, met = differ(staged(asked.where("a <> b").distinct(), "asked"))
            if not last:
                fresh = opened if leads is None else opened.join(leads, ["key", "node"], "left_anti")
                fresh = fresh.join(scores, "node")
                lead = F.struct("score", (-F.col("node")).alias("minus"), "comp", *small)
                best = fresh.groupBy("key").agg(F.max(lead).alias("lead"))
                taken = [F.col(f"lead.{c}").alias(f"l_{c}") for c in small]
                best = staged(best.select(F.col("key").alias("l_key"), (-F.col("lead.minus")).alias("a"), F.col("lead.comp").alias("l_comp"), *taken), "leads")
                named = best.select(F.col("l_key").alias("key"), F.col("a").alias("node"))
                leads = keep(staged(named if leads is None else leads.union(named), "leads"))
            right = opened.select(F.col("node").alias("b"), *(F.col(c).alias(f"r_{c}") for c in ("key", "comp", *small)))
            if last:
                best = opened.select(F.col("node").alias("a"), *(F.col(c).alias(f"l_{c}") for c in ("key", "comp", *small)))
                apart = F.col("l_comp") < F.col("r_comp")
            else:
                apart = F.col("l_comp") != F.col("r_comp")
            pairs = best.join(right, (F.col("l_key") == F.col("r_key")) & apart & near())
            pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))
            if not last:  # payloads are joined for the few leaders that share most with a row; a later round offers others
                ranked = F.sort_array(F.collect_list(F.struct("shared", (-F.col("a")).alias("minus"))), asc=False)
                pairs = pairs.groupBy("b").agg(F.slice(ranked, 1, LEADERS).alias("leads")).select("b", F.explode("leads").alias("x"))
                pairs = pairs.select((-F.col("x.minus")).alias("a"), "b", "x.shared")
            if met is not None:
                pairs = pairs.select("a", "b").union(met.select(F.least("a", "b"), F.greatest("a", "b"))).distinct()
            if likely is not None:
                pairs = _with_payload(pairs, payload).where(likely())
            if not last:  # one leader for each row is enough for now
                pairs = pairs.groupBy("b").agg(F.max(F.struct("shared", (-F.col("a")).alias("a"))).alias("top"))
                pairs = pairs.select((-F.col("top.a")).alias("a"), "b")
            found = verify(staged(pairs.select("a", "b"), "pairs")).select("a", "b")
            if links is not None:
                found = found.union(links.select("a", "b"))
            edges = keep(staged(found if edges is None else edges.union(found), "links"))
            if not edges.isEmpty():
                roots = keep(staged(components(edges), "roots"))
        if last:
            return roots
