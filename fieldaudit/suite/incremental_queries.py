"""Incremental discovery, state merging and board comparison."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators.bootstrap import DRAWS
from ..plans.leaderboard import leaderboard
from ..plans.score import Alarms, pool, score
from ..session import cut_lineage
from ..streaming import incremental as inc
from .base import Tables, query, rounded, s6, with_views
from .score_queries import SUMS, boot_views, sql_rates

NAME = "concat('auto_grown_', date_format(o_orderdate, 'yyyyMMdd'), '000000000_region_', o_orderkey)"
SQL_NAME = "'auto_grown_' || strftime(o_orderdate, '%Y%m%d') || '000000000_region_' || o_orderkey"


@query("new_batches", "SELECT strftime(o_orderdate, '%Y%m%d') || '000000000' AS batch, strftime(o_orderdate, '%Y-%m-%d') AS date, count(*) AS patches FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' GROUP BY 1, 2")
def new_batches(t: Tables):
    live = t.read("orders").selectExpr(f"{NAME} as patch", "o_orderdate")
    return inc.new_batches(live.select("patch"), live.filter("o_orderdate < timestamp_ntz'2000-01-01 00:00:00'").select("patch"))[0].select("batch", "date", "patches")


@query("stale_batches", "SELECT strftime(o_orderdate, '%Y%m%d') || '000000000' AS batch, (SELECT max(strftime(o_orderdate, '%Y%m%d')) || '000000000' FROM orders WHERE o_orderkey % 10 <> 0) AS cutoff FROM orders WHERE o_orderkey % 10 = 0 GROUP BY 1")
def stale_batches(t: Tables):
    """Names that are new but belong to batches not newer than the newest known one."""
    live = t.read("orders").selectExpr(f"{NAME} as patch", "o_orderkey")
    return inc.new_batches(live.select("patch"), live.filter("o_orderkey % 10 <> 0").select("patch"))[1]


@query("batch_overview", f"SELECT count(*) FILTER (o_orderkey % 10 <> 0) AS known_patches, max(strftime(o_orderdate, '%Y%m%d')) FILTER (o_orderkey % 10 <> 0) || '000000000' AS cutoff, count(*) AS live_patches, count(*) FILTER (o_orderkey % 10 = 0) AS new_patches, 0::BIGINT AS without_batch FROM orders")
def batch_overview(t: Tables):
    live = t.read("orders").selectExpr(f"{NAME} as patch", "o_orderkey")
    return inc.batch_overview(live.select("patch"), live.filter("o_orderkey % 10 <> 0").select("patch"))


@query(
    "merged_state_board",
    with_views(f"SELECT detector, hits, events, {sql_rates()}, false_alarms, patches FROM (SELECT {SUMS} FROM patch_score GROUP BY detector)", "patch_score"),
)
def merged_state_board(t: Tables):
    """A board from a state whose even patches were scored again: replacing their rows changes nothing."""
    full = cut_lineage(score(t.benchmark(), t.alarms()).patch_score)  # a row per patch and detector, read twice
    board = pool(inc.merge_scores(full, full.filter("patch % 2 = 0")))
    return rounded(board.select("detector", "hits", "events", "recall", "wilson_lo", "wilson_hi", "false_alarms", "patches"), "recall", "wilson_lo", "wilson_hi")


def _boot(prefix: str, source: str, draws: int) -> dict[str, str]:
    """The bootstrap views under names of their own."""
    views = boot_views(source, draws)
    names = re.compile(r"\b(" + "|".join(views) + r")\b")
    return {prefix + k: names.sub(lambda m: prefix + m[0], v) for k, v in views.items()}


def _half(tag: str, odd: int, draws: int) -> dict[str, str]:
    """Views of one half's board: rates and intervals per detector."""
    cut = lambda p, scale: f"SELECT series, quantile_cont({scale} * num / den, 0.025) AS lo, quantile_cont({scale} * num / den, 0.975) AS hi FROM {p}pooled WHERE den > 0 GROUP BY 1"
    return {
        f"{tag}_rows": f"SELECT * FROM patch_score WHERE patch % 2 = {odd}",
        **_boot(f"{tag}r_", f"SELECT patch AS block, detector AS series, hits AS num, events AS den FROM {tag}_rows WHERE events > 0", draws),
        **_boot(f"{tag}f_", f"SELECT patch AS block, detector AS series, false_alarms AS num, length AS den FROM {tag}_rows", draws),
        f"{tag}_r": cut(f"{tag}r_", "1.0::DOUBLE"), f"{tag}_f": cut(f"{tag}f_", "100.0::DOUBLE"),
        f"{tag}_board": f"""SELECT detector, sum(events) AS events, sum(length) AS length, count(*) FILTER (events > 0) AS event_patches, count(*) AS patches,
            sum(hits) / nullif(sum(events)::DOUBLE, 0) AS recall, 100.0::DOUBLE * sum(false_alarms) / nullif(sum(length), 0) AS fa_per_100,
            any_value(r.lo) AS r_lo, any_value(r.hi) AS r_hi, any_value(f.lo) AS f_lo, any_value(f.hi) AS f_hi
            FROM {tag}_rows LEFT JOIN {tag}_r r ON r.series = detector LEFT JOIN {tag}_f f ON f.series = detector GROUP BY 1""",
    }


def _changed(has: str, blocks: str, m: str) -> str:
    return f"""CASE WHEN NOT coalesce({has} > 0, FALSE) THEN 'not enough new data' WHEN {blocks} < 5 THEN 'too few blocks'
        WHEN coalesce(c.{m}_lo <= b.{m}_hi AND b.{m}_lo <= c.{m}_hi, TRUE) THEN 'within noise' ELSE 'changed beyond noise' END"""


@query(
    "board_diff",
    with_views(
        f"""SELECT c.detector, {_changed('c.events', 'c.event_patches', 'r')} AS recall_verdict, {_changed('c.length', 'c.patches', 'f')} AS fa_verdict,
        {s6('c.recall')} AS recall, {s6('b.recall')} AS base_recall, {s6('c.fa_per_100')} AS fa_per_100, {s6('b.fa_per_100')} AS base_fa_per_100
        FROM cand_board c JOIN base_board b ON b.detector = c.detector""", "patch_score",
        extra={**_half("cand", 1, DRAWS), **_half("base", 0, DRAWS)}),
)
def board_diff(t: Tables):
    """Odd patches as the candidate against even patches as the baseline, per detector."""
    frames = score(t.benchmark(), t.alarms()).materialised()  # both boards read the same patch scores
    rows = frames.patch_score

    def board(keep):
        import dataclasses

        part = dataclasses.replace(frames, patch_score=rows.filter(keep), detector_score=pool(rows.filter(keep)))
        return leaderboard(part)

    out = inc.diff_boards(board("patch % 2 = 1"), board("patch % 2 = 0"))
    return rounded(out, "recall", "base_recall", "fa_per_100", "base_fa_per_100")
