"""SQL of the named queries, written for DuckDB and independent of the Spark plans: pairs by self join, ranks by listing the product space,
rank sums over explicit zeros."""

from __future__ import annotations

from seedquorum.functions import scalar as S
from seedquorum.sources.binding import GENES, METHODS, K, SEEDS

UNIT = "dataset, method"


def select(spec: str, body: str) -> str:
    """Columns by a spec: ``name``, ``name:i`` (bigint), ``name:d`` (double, nine digits)."""
    cols = []
    for item in spec.split():
        name, _, kind = item.partition(":")
        q = f'"{name}"'
        cols.append({"i": f"CAST({q} AS BIGINT) AS {q}", "d": f"round(CAST({q} AS DOUBLE), 9) + 0e0 AS {q}", "": q}[kind])
    return f"SELECT {', '.join(cols)} FROM ({body}) AS q"


def _runs(obs: str) -> str:
    values = ", ".join(f"('{m}', {o}, {n})" for m, o, n in METHODS)
    return f"""m(method, ord, noise) AS (VALUES {values}), obs AS ({obs}),
runs AS (SELECT dataset, method, ord, seed, obs_id, ref, CAST(CASE WHEN (obs_id * 31 + seed * 17 + ord * 7 + (obs_id % 97) * seed) % 100 < noise + seed % 5
  THEN (obs_id + seed * 3) % {K} ELSE (ref + seed) % {K} END AS INTEGER) AS cluster FROM obs, m, range(1, {SEEDS + 1}) AS s(seed))"""


RUNS = _runs(f"SELECT o_orderstatus AS dataset, o_orderkey AS obs_id, ascii(o_orderpriority) % {K} AS ref FROM orders")


def agree(name: str, cells: str, keys: str) -> str:
    """CTEs that end in ``name``: keys, n_obs, k_a, k_b, ari, nmi."""
    return f"""{name}_s AS (SELECT {keys}, sum(n) AS nn, sum(n * (n - 1) / 2e0) AS s FROM {cells} GROUP BY {keys}),
{name}_ra AS (SELECT {keys}, a, sum(n) AS na FROM {cells} GROUP BY {keys}, a), {name}_rb AS (SELECT {keys}, b, sum(n) AS nb FROM {cells} GROUP BY {keys}, b),
{name}_a AS (SELECT {keys}, count(*) AS k_a, sum(na * (na - 1) / 2e0) AS pa, -sum(na / nn * ln(na / nn)) AS ha FROM {name}_ra JOIN {name}_s USING ({keys}) GROUP BY {keys}),
{name}_b AS (SELECT {keys}, count(*) AS k_b, sum(nb * (nb - 1) / 2e0) AS pb, -sum(nb / nn * ln(nb / nn)) AS hb FROM {name}_rb JOIN {name}_s USING ({keys}) GROUP BY {keys}),
{name}_m AS (SELECT {keys}, sum(n / nn * ln(n * nn / (na * nb))) AS mi FROM {cells} JOIN {name}_ra USING ({keys}, a) JOIN {name}_rb USING ({keys}, b) JOIN {name}_s USING ({keys}) GROUP BY {keys}),
{name} AS (SELECT {keys}, nn AS n_obs, k_a, k_b,
  CASE WHEN s = pa AND s = pb THEN 1e0 WHEN (pa + pb) / 2e0 = pa * pb / (nn * (nn - 1) / 2e0) THEN 1e0 ELSE (s - pa * pb / (nn * (nn - 1) / 2e0)) / ((pa + pb) / 2e0 - pa * pb / (nn * (nn - 1) / 2e0)) END AS ari,
  CASE WHEN k_a = 1 AND k_b = 1 THEN 1e0 WHEN k_a = 1 OR k_b = 1 THEN 0e0 WHEN s = pa AND s = pb THEN 1e0 ELSE greatest(mi, 0e0) / ((ha + hb) / 2e0) END AS nmi
  FROM {name}_s JOIN {name}_a USING ({keys}) JOIN {name}_b USING ({keys}) JOIN {name}_m USING ({keys}))"""


_ACC = "ac AS (SELECT dataset, method, seed, ref AS a, cluster AS b, count(*) AS n FROM runs WHERE ref IS NOT NULL GROUP BY ALL), " + agree("acc0", "ac", "dataset, method, seed") + ", acc AS (SELECT dataset, method, seed, n_obs, k_a, k_b, ari, nmi FROM acc0)"
_PAIR = "pc AS (SELECT r.dataset, r.method, r.seed AS seed_r, s.seed AS seed_s, r.cluster AS a, s.cluster AS b, count(*) AS n FROM runs r JOIN runs s ON r.dataset = s.dataset AND r.method = s.method AND r.obs_id = s.obs_id AND r.seed < s.seed GROUP BY ALL), " + agree("pr0", "pc", "dataset, method, seed_r, seed_s") + ", pr AS (SELECT dataset, method, seed_r, seed_s, n_obs, ari, nmi FROM pr0)"
_SP = f"sp AS (SELECT pr.dataset, pr.method, seed_r, seed_s, pr.ari AS partition_ari, pr.nmi AS partition_nmi, r.ari AS ari_r, s.ari AS ari_s, abs(r.ari - s.ari) AS abs_difference FROM pr JOIN acc r ON r.dataset = pr.dataset AND r.method = pr.method AND r.seed = seed_r JOIN acc s ON s.dataset = pr.dataset AND s.method = pr.method AND s.seed = seed_s), iso AS (SELECT * FROM sp WHERE abs_difference <= {S.PRIMARY_ISO} + 1e-12)"
ACC, PAIRS = f"{RUNS}, {_ACC}", f"{RUNS}, {_ACC}, {_PAIR}, {_SP}"
UNITS = f"""{PAIRS}, un AS (SELECT * , 1 - median_pair_ari AS instability FROM
 (SELECT dataset, method, count(*) AS n_seeds, median(ari) AS median_reference_ari, stddev_samp(ari) AS reference_ari_sd, min(ari) AS reference_ari_min, max(ari) AS reference_ari_max, max(ari) - min(ari) AS reference_ari_range, median(nmi) AS median_reference_nmi, stddev_samp(nmi) AS reference_nmi_sd FROM acc GROUP BY ALL)
 LEFT JOIN (SELECT dataset, method, median(ari) AS median_pair_ari, quantile_cont(ari, 0.05) AS p05_pair_ari, min(ari) AS min_pair_ari, median(nmi) AS median_pair_nmi, quantile_cont(nmi, 0.05) AS p05_pair_nmi, min(nmi) AS min_pair_nmi FROM pr GROUP BY ALL) USING (dataset, method)),
units AS (SELECT *, coalesce(round(reference_ari_sd, 9) <= 0.02 + 1e-12 AND round(instability, 9) >= 0.3 - 1e-12, false) AS low_sd_high_instability FROM un)"""
ISO = f"""{UNITS}, th(threshold) AS (VALUES {", ".join(f"({t}e0)" for t in S.ISO_THRESHOLDS)}),
isos AS (SELECT u.dataset, u.method, threshold, count(partition_ari) AS n_iso_pairs, median(partition_ari) AS median_partition_ari, min(partition_ari) AS min_partition_ari, count(*) FILTER (partition_ari < 0.5) AS n_divergent FROM units u CROSS JOIN th LEFT JOIN sp ON sp.dataset = u.dataset AND sp.method = u.method AND abs_difference <= threshold + 1e-12 GROUP BY ALL)"""

# ---- ranking by listing every combination
_SCORES = f"{ACC}, sc AS (SELECT dataset, method, ord, seed, ari FROM acc JOIN m USING (method))"
_N = [m for m, _, _ in METHODS]
_ALL = "prod AS (SELECT t1.dataset, " + ", ".join(f"t{i}.ari AS s{i}" for i in range(1, 6)) + " FROM " + " ".join(f"sc t{i}" if i == 1 else f"JOIN sc t{i} ON t{i}.dataset = t1.dataset AND t{i}.method = '{_N[i - 1]}'" for i in range(1, 6)) + f" WHERE t1.method = '{_N[0]}')"
_LONG = "lr AS (" + " UNION ALL ".join(f"SELECT dataset, '{_N[i - 1]}' AS method, " + " + ".join(f"(s{j} > s{i})::INT" for j in range(1, 6) if j != i) + " AS g, " + " + ".join(f"(s{j} = s{i})::INT" for j in range(1, 6) if j != i) + " AS t, count(*) AS c FROM prod GROUP BY ALL" for i in range(1, 6)) + ")"
RANK = f"""{_SCORES}, {_ALL}, {_LONG}, rd AS (SELECT dataset, method, rank_x2, coalesce(sum(c), 0) AS combos FROM (SELECT DISTINCT dataset, method FROM sc) CROSS JOIN range(2, 11) AS r(rank_x2) LEFT JOIN (SELECT dataset, method, 2 + 2 * g + t AS rank_x2, c FROM lr) USING (dataset, method, rank_x2) GROUP BY ALL),
wp AS (SELECT dataset, method, sum(CASE WHEN g = 0 THEN c * 60 // (t + 1) ELSE 0 END) AS credit, sum(c) * 60 AS credit_denominator, sum(CASE WHEN g = 0 THEN c * 60 // (t + 1) ELSE 0 END) / (sum(c) * 60) AS p_rank1 FROM lr GROUP BY ALL),
wu AS (SELECT dataset, sum(credit) AS credit_sum, max(p_rank1) AS max_p_rank1, (SELECT string_agg(w.method, ';' ORDER BY ord) FROM wp w JOIN m USING (method) WHERE w.dataset = wp.dataset AND w.credit = max(wp.credit)) AS most_probable_winner, count(*) FILTER (p_rank1 > 0) AS n_positive, count(*) FILTER (p_rank1 >= 0.05) AS n_at_least_5_percent, -sum(CASE WHEN p_rank1 > 0 THEN p_rank1 * log2(p_rank1) ELSE 0 END) AS entropy_bits, -sum(CASE WHEN p_rank1 > 0 THEN p_rank1 * log2(p_rank1) ELSE 0 END) / log2(5) AS entropy_normalized FROM wp GROUP BY dataset)"""

# ---- markers over explicit zeros
EXPR = f"""ob AS (SELECT o_orderstatus AS dataset, o_orderkey AS obs_id FROM orders), ex AS (SELECT dataset, obs_id, gene, value FROM (SELECT l_orderkey AS obs_id, l_partkey % {GENES} AS gene, sum(l_quantity) AS value FROM lineitem GROUP BY ALL) JOIN ob USING (obs_id)),
nx AS (SELECT dataset, obs_id, gene, round(ln(1 + value * 1e4 / sum(value) OVER (PARTITION BY dataset, obs_id)), 9) AS value FROM ex)"""
MARK = f"""{RUNS}, {EXPR}, genes AS (SELECT DISTINCT dataset, gene FROM nx WHERE value > 0),
dense AS (SELECT dataset, obs_id, gene, coalesce(value, 0e0) AS value FROM ob JOIN genes USING (dataset) LEFT JOIN nx USING (dataset, obs_id, gene)),
rk AS (SELECT dataset, obs_id, gene, rank() OVER (PARTITION BY dataset, gene ORDER BY value) + (count(*) OVER (PARTITION BY dataset, gene, value) - 1) / 2e0 AS r, count(*) OVER (PARTITION BY dataset, gene) AS nn FROM dense),
rs AS (SELECT dataset, method, seed, cluster AS domain, gene, sum(r) AS r, count(*) AS n1, max(nn) AS nn FROM rk JOIN runs USING (dataset, obs_id) GROUP BY ALL),
zs AS (SELECT dataset, method, seed, domain, gene, round((r - n1 * (nn + 1) / 2e0) / nullif(sqrt(n1::DOUBLE * (nn - n1) * (nn + 1) / 12e0), 0), 9) AS z FROM rs),
mk AS (SELECT *, row_number() OVER (PARTITION BY dataset, method, seed, domain ORDER BY z DESC NULLS LAST, gene) AS rank FROM zs)"""
MPAIR = f"""{MARK}, mp AS (SELECT r.dataset, r.method, r.seed AS seed_r, s.seed AS seed_s, r.domain, count(*) FILTER (r.rank <= least(20, nd) AND s.rank <= least(20, nd)) AS s, max(least(20, nd)) AS k, sum((r.rank - s.rank)::DOUBLE * (r.rank - s.rank)) AS d2, max(nd) AS n
 FROM (SELECT *, count(*) OVER (PARTITION BY dataset, method, seed, domain) AS nd FROM mk) r JOIN mk s ON r.dataset = s.dataset AND r.method = s.method AND r.domain = s.domain AND r.gene = s.gene AND r.seed < s.seed GROUP BY ALL),
mm AS (SELECT dataset, method, seed_r, seed_s, domain, s / (2 * k - s) AS jaccard, 1 - 6 * d2 / (n::DOUBLE * (n::DOUBLE * n - 1)) AS rank_spearman FROM mp),
mr AS (SELECT dataset, method, seed_r, seed_s, median(jaccard) AS jaccard, median(rank_spearman) AS rank_spearman, count(*) AS domains FROM mm GROUP BY ALL),
{_ACC}, {_PAIR}, prm AS (SELECT pr.dataset, pr.method, pr.seed_r, pr.seed_s, pr.ari AS partition_ari, jaccard, rank_spearman, domains FROM pr LEFT JOIN mr USING (dataset, method, seed_r, seed_s)),
ter AS (SELECT *, CASE ntile(3) OVER (PARTITION BY dataset, method ORDER BY partition_ari, seed_r, seed_s) WHEN 1 THEN 'Low' WHEN 2 THEN 'Middle' ELSE 'High' END AS tertile FROM prm)"""
POINTS = "pt AS (SELECT vec_id AS obs_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label FROM embeddings)"
NEAR = f"{POINTS}, nb AS (SELECT * FROM (SELECT a.obs_id AS src, b.obs_id AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance, row_number() OVER (PARTITION BY a.obs_id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.obs_id) AS rank FROM pt a JOIN pt b ON a.obs_id <> b.obs_id) WHERE rank <= 6)"
RADIUS = 0.02
SPACE = f"""{NEAR.replace("rank <= 6", "rank <= 15")}, ve AS (SELECT vec_id AS obs_id, g - 1 AS gene, embedding[g]::DOUBLE AS value FROM embeddings, range(3, 65) AS r(g) WHERE embedding[g] > 0),
 we AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS weight FROM (SELECT src, dst, CASE WHEN m > 0 THEN exp(-(distance / m) * (distance / m)) WHEN distance = 0 THEN 1e0 ELSE 0e0 END AS w FROM (SELECT *, median(distance) OVER (PARTITION BY src) AS m FROM nb))),
 nm AS (SELECT src, gene, sum(weight * value) AS value FROM we JOIN ve ON ve.obs_id = dst GROUP BY ALL)"""


_FOUR = f"""{_SCORES}, four AS (SELECT t1.dataset, {", ".join(f"t{i}.ari AS s{i}" for i in range(1, 5))} FROM {" ".join(f"sc t{i}" if i == 1 else f"JOIN sc t{i} ON t{i}.dataset = t1.dataset AND t{i}.method = '{_N[i - 1]}'" for i in range(1, 5))} WHERE t1.method = 'm1')"""


def midrank(part: str, value: str) -> str:
    p = f"PARTITION BY {part}" if part else ""
    q = f"PARTITION BY {part + ', ' if part else ''}{value}"
    return f"rank() OVER ({p} ORDER BY {value}) + (count(*) OVER ({q}) - 1) / 2e0"


ORACLES: dict[str, str] = {
    "seed_accuracy": f"WITH {ACC} SELECT dataset, method, seed, n_obs, k_a AS k_ref, k_b AS k_observed, ari, nmi FROM acc",
    "contingency": f"WITH {RUNS} SELECT dataset, method, seed, ref AS a, cluster AS b, count(*) AS n FROM runs GROUP BY ALL",
    "pair_agreement": f"WITH {PAIRS} SELECT dataset, method, seed_r, seed_s, n_obs, ari, nmi FROM pr",
    "seed_pairs": f"WITH {PAIRS} SELECT *, abs_difference <= 0.01 + 1e-12 AS iso_001, abs_difference <= 0.02 + 1e-12 AS iso_002, abs_difference <= 0.03 + 1e-12 AS iso_003 FROM sp",
    "unit_summary": f"WITH {UNITS} SELECT * FROM units",
    "section_summary": f"WITH {UNITS} SELECT dataset, count(*) AS n_methods, median(median_reference_ari) AS median_reference_ari, median(reference_ari_sd) AS median_reference_ari_sd, median(median_pair_ari) AS median_pair_ari, median(instability) AS median_instability FROM units GROUP BY dataset",
    "observed_k": f"WITH {RUNS} SELECT dataset, method, min(k) AS k_min, max(k) AS k_max FROM (SELECT dataset, method, seed, count(DISTINCT cluster) AS k FROM runs GROUP BY ALL) GROUP BY ALL",
    "iso_summary": f"WITH {ISO} SELECT *, n_divergent / nullif(n_iso_pairs, 0) AS divergent_fraction, n_divergent > 0 AS contains_divergent FROM isos",
    "iso_divergent_pairs": f"WITH {PAIRS} SELECT dataset, method, seed_r, seed_s, partition_ari FROM iso WHERE partition_ari < 0.5",
    "iso_representative": f"WITH {PAIRS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, method ORDER BY partition_ari, seed_r, seed_s) AS k FROM iso) WHERE k = 1",
    "stable_control": f"""WITH {PAIRS}, u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, method ORDER BY partition_ari, seed_r, seed_s) AS k FROM iso) WHERE k = 1),
 j AS (SELECT sp.dataset, sp.method, u.seed_r AS unstable_r, u.seed_s AS unstable_s, u.partition_ari AS unstable_ari, sp.seed_r AS stable_r, sp.seed_s AS stable_s, sp.partition_ari AS stable_ari, abs(sp.abs_difference - u.abs_difference) AS gap FROM sp JOIN u ON sp.dataset = u.dataset AND sp.method = u.method WHERE sp.seed_r <> u.seed_r OR sp.seed_s <> u.seed_s)
 SELECT * FROM (SELECT *, gap <= 0.002 + 1e-12 AS within_caliper, row_number() OVER (PARTITION BY dataset, method ORDER BY CASE WHEN gap <= 0.002 + 1e-12 THEN 0 ELSE 1 END, CASE WHEN gap <= 0.002 + 1e-12 THEN 0 ELSE gap END, stable_ari DESC, stable_r, stable_s) AS k FROM j) WHERE k = 1""",
    "global_example": f"WITH {PAIRS} SELECT * FROM iso ORDER BY partition_ari, dataset, method, seed_r, seed_s LIMIT 1",
    "threshold_sensitivity": f"WITH {ISO} SELECT threshold, count(DISTINCT sp.dataset || sp.method) AS n_units, count(*) AS n_iso_pairs, count(*) FILTER (partition_ari < 0.5) AS n_divergent, count(*) FILTER (partition_ari < 0.5) / count(*) AS divergent_fraction, median(partition_ari) AS pooled_median_partition_ari FROM th JOIN sp ON abs_difference <= threshold + 1e-12 GROUP BY threshold",
    "score_map_decoupling": f"WITH {UNITS}, r AS (SELECT {midrank('', 'reference_ari_sd')} AS x, {midrank('', 'instability')} AS y FROM (SELECT round(reference_ari_sd, 9) AS reference_ari_sd, round(instability, 9) AS instability FROM units)) SELECT count(*) AS n_units, corr(x, y) AS spearman FROM r",
    "seed_percentile": f"WITH {ACC} SELECT dataset, method, max(v.ari) AS value, 100 * avg((acc.ari <= v.ari)::INT::DOUBLE) AS percentile FROM acc JOIN (SELECT dataset, method, ari FROM acc WHERE seed = 1) v USING (dataset, method) GROUP BY ALL",
    "headline_summary": f"WITH {ISO} SELECT * FROM (SELECT count(*) AS n_units, count(DISTINCT dataset) AS n_datasets, count(DISTINCT method) AS n_methods, sum(n_seeds) AS n_runs, count(*) FILTER (low_sd_high_instability) AS n_low_sd_high_instability, median(instability) AS median_instability, quantile_cont(instability, 0.25) AS q25_instability, quantile_cont(instability, 0.75) AS q75_instability FROM units), (SELECT sum(n_iso_pairs) AS n_iso_pairs, sum(n_divergent) AS n_divergent, count(*) FILTER (n_divergent > 0) AS n_units_with_divergent, sum(n_divergent) / nullif(sum(n_iso_pairs), 0) AS divergent_fraction FROM isos WHERE abs(threshold - 0.02) <= 1e-12)",
    "classification": f"""WITH {ISO}, r AS (SELECT {midrank('', 'reference_ari_sd')} AS x, {midrank('', 'instability')} AS y FROM (SELECT round(reference_ari_sd, 9) AS reference_ari_sd, round(instability, 9) AS instability FROM units)),
 p AS (SELECT (SELECT sum(n_divergent) > 0 FROM isos WHERE threshold = 0.02) AS has_divergent, (SELECT 2 * count(*) FILTER (n_divergent > 0) >= count(*) FROM isos WHERE threshold = 0.02) AS widespread, (SELECT median(instability) >= 0.3 FROM units) AS unstable, coalesce((SELECT abs(corr(x, y)) < 0.5 FROM r), false) AS decoupled)
 SELECT *, CASE n_components WHEN 4 THEN 'STRONG' WHEN 1 THEN 'WEAK' WHEN 0 THEN 'WEAK' ELSE 'PARTIAL' END AS class FROM (SELECT *, has_divergent::INT + widespread::INT + unstable::INT + decoupled::INT AS n_components FROM p)""",
    "component_labels": f"""WITH {ISO}, {MPAIR.replace(f"{RUNS}, ", "", 1).replace(f"{_ACC}, {_PAIR}, ", "", 1)}, {RANK.replace(f"{ACC}, ", "", 1)},
 rho AS (SELECT dataset, method, corr(x, y) AS spearman FROM (SELECT dataset, method, {midrank('dataset, method', 'partition_ari')} AS x, {midrank('dataset, method', 'jaccard')} AS y FROM (SELECT * REPLACE (round(jaccard, 9) AS jaccard) FROM prm WHERE jaccard IS NOT NULL)) GROUP BY ALL),
 c AS (SELECT 'score_map_decoupling' AS component, count(*) FILTER (low_sd_high_instability) AS yes, count(*) AS n FROM units UNION ALL SELECT 'iso_accuracy_map_divergence', count(*) FILTER (n_divergent > 0), count(*) FROM isos WHERE abs(threshold - 0.02) < 1e-9
  UNION ALL SELECT 'winner_distribution_contribution', count(*) FILTER (p_rank1 > 0), count(*) FROM wp WHERE method = 'm1' UNION ALL SELECT 'partition_marker_relationship', count(*) FILTER (spearman > 0), count(spearman) FROM rho),
 l AS (SELECT *, CASE WHEN n = 0 THEN 'NOT_ESTIMABLE' WHEN yes = n THEN 'SUPPORTS_EXISTING_PATTERN' WHEN yes = 0 THEN 'DOES_NOT_SUPPORT' ELSE 'HETEROGENEOUS' END AS label FROM c)
 SELECT *, CASE WHEN (SELECT count(*) FROM l WHERE label = 'DOES_NOT_SUPPORT' AND component IN ('score_map_decoupling', 'iso_accuracy_map_divergence')) = 2 THEN 'CONTRASTING_STOCHASTIC_PROFILE'
  WHEN (SELECT count(*) FROM l WHERE label = 'SUPPORTS_EXISTING_PATTERN') >= 4 AND NOT EXISTS (FROM l WHERE label = 'DOES_NOT_SUPPORT') THEN 'STRONG_METHOD_GENERALIZATION' WHEN (SELECT count(*) FROM l WHERE label = 'SUPPORTS_EXISTING_PATTERN') >= 2 THEN 'PARTIAL_METHOD_GENERALIZATION' ELSE 'LIMITED_METHOD_GENERALIZATION' END AS overall FROM l""",
    "rank_distribution": f"WITH {RANK} SELECT * FROM rd",
    "winner_probability": f"WITH {RANK} SELECT * FROM wp",
    "rank_summary": f"WITH {RANK}, cu AS (SELECT *, sum(combos) OVER (PARTITION BY dataset, method ORDER BY rank_x2) AS cum, sum(combos) OVER (PARTITION BY dataset, method) AS n FROM rd) SELECT cu.dataset, cu.method, max(n) AS combos, sum(combos * rank_x2) / 2e0 / max(n) AS expected_rank, min(rank_x2) FILTER (cum >= ceil(n / 2e0)) / 2e0 AS median_rank, sum(combos) FILTER (rank_x2 <= 4) / max(n) AS p_top2, sum(combos) FILTER (rank_x2 <= 6) / max(n) AS p_top3, max(p_rank1) AS p_rank1 FROM cu JOIN wp USING (dataset, method) GROUP BY ALL",
    "winner_uncertainty": f"WITH {RANK} SELECT * FROM wu",
    "lowest_certainty": f"WITH {RANK} SELECT * FROM wu ORDER BY round(max_p_rank1, 12), dataset LIMIT 3",
    "pairwise_superiority": f"WITH {_SCORES}, j AS (SELECT a.dataset, a.method AS method_a, b.method AS method_b, count(*) FILTER (a.ari > b.ari) AS a_gt_b, count(*) FILTER (a.ari < b.ari) AS b_gt_a, count(*) FILTER (a.ari = b.ari) AS ties, count(*) AS n FROM sc a JOIN sc b ON a.dataset = b.dataset AND a.ord < b.ord GROUP BY ALL) SELECT *, a_gt_b * 8000 AS a_gt_b_expanded, b_gt_a * 8000 AS b_gt_a_expanded, ties * 8000 AS ties_expanded, a_gt_b / n AS p_a_gt_b, b_gt_a / n AS p_b_gt_a, ties / n AS p_tie FROM j",
    "matched_rank": f"WITH {_SCORES} SELECT dataset, method, seed, rank() OVER (PARTITION BY dataset, seed ORDER BY ari DESC) AS rank FROM sc",
    "matched_rank_summary": f"""WITH {_SCORES}, r AS (SELECT *, rank() OVER (PARTITION BY dataset, seed ORDER BY ari DESC) AS rank FROM sc), w AS (SELECT dataset, seed, arg_min(method, ord) AS winner FROM r WHERE rank = 1 GROUP BY ALL),
 c AS (SELECT w.dataset, avg((w.winner <> f.winner)::INT::DOUBLE) AS winner_change_frequency, count(DISTINCT w.winner) AS n_winners FROM w JOIN w f ON f.dataset = w.dataset AND f.seed = 1 GROUP BY ALL),
 md AS (SELECT dataset, method, rank() OVER (PARTITION BY dataset ORDER BY x DESC) AS median_ari_rank FROM (SELECT dataset, method, median(ari) AS x FROM sc GROUP BY ALL))
 SELECT dataset, method, median(rank) AS median_rank, min(rank) AS best_rank, max(rank) AS worst_rank, avg((rank <= 1)::INT::DOUBLE) AS top1_frequency, avg((rank <= 2)::INT::DOUBLE) AS top2_frequency, avg((rank <= 3)::INT::DOUBLE) AS top3_frequency, max(rank) FILTER (seed = 1) AS seed1_rank, max(median_ari_rank) AS median_ari_rank, max(winner_change_frequency) AS winner_change_frequency, max(n_winners) AS n_winners FROM r JOIN md USING (dataset, method) JOIN c USING (dataset) GROUP BY ALL""",
    "alignment_overlap": f"""WITH {RUNS}, ov AS (SELECT r.dataset, r.method, r.seed, r.cluster AS a, s.cluster AS b, count(*) AS n FROM runs r JOIN runs s ON s.dataset = r.dataset AND s.method = r.method AND s.obs_id = r.obs_id AND s.seed = 1 GROUP BY ALL),
 d AS (SELECT * FROM range({K}) x(p)), pm AS (SELECT a.p AS p0, b.p AS p1, c.p AS p2, d4.p AS p3, e.p AS p4 FROM d a, d b, d c, d d4, d e WHERE len(list_distinct([a.p, b.p, c.p, d4.p, e.p])) = 5)
 SELECT dataset, method, seed, max(t) AS overlap FROM (SELECT dataset, method, seed, p0, p1, p2, p3, p4, sum(n) AS t FROM pm JOIN ov ON (a = 0 AND b = p0) OR (a = 1 AND b = p1) OR (a = 2 AND b = p2) OR (a = 3 AND b = p3) OR (a = 4 AND b = p4) GROUP BY ALL) GROUP BY ALL""",
    "coassociation": f"""WITH {RUNS}, sg AS (SELECT dataset, method, code, count(*) AS w FROM (SELECT dataset, method, obs_id, sum(cluster::BIGINT << (3 * (seed - 1)))::BIGINT AS code FROM runs GROUP BY ALL) GROUP BY ALL),
 b AS (SELECT a.dataset, a.method, xor(a.code, b.code) AS x, CASE WHEN a.code = b.code THEN a.w * (a.w - 1) // 2 ELSE a.w * b.w END AS n FROM sg a JOIN sg b ON a.dataset = b.dataset AND a.method = b.method AND a.code <= b.code)
 SELECT dataset, method, {SEEDS} - bit_count((x | (x >> 1) | (x >> 2)) & {sum(1 << 3 * i for i in range(SEEDS))}) AS seeds_together, sum(n) AS n_pairs FROM b GROUP BY ALL HAVING sum(n) > 0""",
    "reference_support": f"""WITH {RUNS}, me AS (SELECT dataset, method, ref, count(DISTINCT obs_id) AS members FROM runs GROUP BY ALL), tg AS (SELECT dataset, method, seed, ref, cluster, count(*) AS n FROM runs GROUP BY ALL),
 su AS (SELECT dataset, method, obs_id, round(CASE WHEN max(members) = 1 THEN 1e0 ELSE avg((n - 1) / (members - 1)::DOUBLE) END, 9) AS support FROM runs JOIN tg USING (dataset, method, seed, ref, cluster) JOIN me USING (dataset, method, ref) GROUP BY ALL)
 SELECT dataset, method, obs_id, support, CASE WHEN support >= {S.HIGH_SUPPORT} THEN 'high' WHEN support <= {S.LOW_SUPPORT} THEN 'low' ELSE 'intermediate' END AS class FROM su""",
    "normalize_log1p": f"WITH {EXPR} SELECT * FROM nx",
    "gene_filter": f"WITH {EXPR} SELECT dataset, obs_id, gene, value FROM ex JOIN (SELECT dataset, gene FROM ex GROUP BY ALL HAVING count(*) FILTER (value > 0) >= 50 AND sum(value) >= 1500) USING (dataset, gene)",
    "gene_moments": f"WITH {EXPR}, nn AS (SELECT dataset, count(*) AS n FROM ob GROUP BY ALL) SELECT dataset, gene, n, sum(value) / n AS mean, (sum(value * value) - sum(value) * sum(value) / n) / (n - 1) AS variance FROM ex JOIN nn USING (dataset) GROUP BY dataset, gene, n",
    "matrix_statistics": f"WITH {EXPR} SELECT dataset, count(*) AS n_stored, count(DISTINCT gene) AS n_genes, count(DISTINCT obs_id) AS n_obs, min(value) AS min_value, max(value) AS max_value, count(*) FILTER (value IS NULL OR isnan(value) OR isinf(value)) AS n_nonfinite, count(*) FILTER (value < 0) AS n_negative, bool_and(value = floor(value)) AS all_integers, 0 AS n_duplicates, count(*) / (count(DISTINCT gene) * count(DISTINCT obs_id)) AS density FROM ex GROUP BY ALL",
    "rank_sum_markers": f"WITH {MARK} SELECT * FROM mk",
    "marker_topk": f"WITH {MARK} SELECT dataset, method, seed, domain, gene, rank FROM mk WHERE rank <= 20",
    "marker_jaccard": f"WITH {MPAIR} SELECT dataset, method, seed_r, seed_s, domain, jaccard FROM mm",
    "marker_rank_spearman": f"WITH {MPAIR} SELECT dataset, method, seed_r, seed_s, domain, rank_spearman FROM mm",
    "marker_pairs": f"WITH {MPAIR} SELECT * FROM prm",
    "marker_frequency": f"WITH {MARK} SELECT dataset, method, domain, gene, count(*) AS n_seeds, count(*) / 20e0 AS frequency, CASE WHEN count(*) / 20e0 >= 0.8 THEN '>=80%' WHEN count(*) / 20e0 <= 0.2 THEN '<=20%' ELSE '20-80%' END AS class FROM mk WHERE rank <= 20 GROUP BY ALL",
    "marker_overlap": f"WITH {MARK}, t AS (SELECT dataset, method, domain, gene, bool_or(seed = 1) AS r, bool_or(seed = 2) AS s FROM mk WHERE rank <= 20 AND seed IN (1, 2) GROUP BY ALL) SELECT dataset, method, domain, count(*) FILTER (r AND NOT s) AS only_r, count(*) FILTER (r AND s) AS shared, count(*) FILTER (s AND NOT r) AS only_s FROM t GROUP BY ALL",
    "pair_tertiles": f"WITH {PAIRS} SELECT dataset, method, seed_r, seed_s, CASE ntile(3) OVER (PARTITION BY dataset, method ORDER BY ari, seed_r, seed_s) WHEN 1 THEN 'Low' WHEN 2 THEN 'Middle' ELSE 'High' END AS tertile FROM pr",
    "tertile_summary": f"WITH {MPAIR} SELECT dataset, method, tertile, count(*) AS n_pairs, median(partition_ari) AS median_partition_ari, median(jaccard) AS median_value FROM ter GROUP BY ALL",
    "within_unit_spearman": f"WITH {MPAIR} SELECT dataset, method, count(*) AS n, corr(x, y) AS spearman FROM (SELECT dataset, method, {midrank('dataset, method', 'partition_ari')} AS x, {midrank('dataset, method', 'jaccard')} AS y FROM (SELECT * REPLACE (round(jaccard, 9) AS jaccard) FROM prm WHERE jaccard IS NOT NULL)) GROUP BY ALL",
    "signed_rank": f"WITH {UNITS}, d AS (SELECT round(median_reference_ari - median_pair_ari, 9) AS d FROM units), r AS (SELECT d, {midrank('', 'm')} AS rank, count(*) OVER (PARTITION BY m) AS t FROM (SELECT d, abs(d) AS m FROM d WHERE d <> 0)) SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN rank ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN rank ELSE 0 END) AS w_minus, (sum(CASE WHEN d > 0 THEN rank ELSE 0 END) - count(*) * (count(*) + 1) / 4e0) / sqrt(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24e0 - sum(t * t - 1) / 48e0) AS z, (sum(CASE WHEN d > 0 THEN rank ELSE 0 END) - sum(CASE WHEN d < 0 THEN rank ELSE 0 END)) / sum(rank) AS rank_biserial, (SELECT count(*) FILTER (d = 0) FROM d) AS n_zero, (SELECT count(*) FROM d) AS n_pairs FROM r",
    "nearest_neighbours": f"WITH {NEAR} SELECT * FROM nb",
    "knn_boundary": f"WITH {NEAR} SELECT src AS obs_id, coalesce(bool_or(a.label <> b.label), false) AS is_boundary FROM nb JOIN pt a ON a.obs_id = src JOIN pt b ON b.obs_id = dst GROUP BY src",
    "radius_degree": f"WITH {POINTS} SELECT a.obs_id, count(b.obs_id) AS degree FROM pt a LEFT JOIN pt b ON a.obs_id <> b.obs_id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {RADIUS} GROUP BY ALL",
    "geometry_audit": f"WITH {NEAR}, dg AS (SELECT a.obs_id, count(b.obs_id) AS degree FROM pt a LEFT JOIN pt b ON a.obs_id <> b.obs_id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {RADIUS} GROUP BY ALL) SELECT count(*) AS n, quantile_cont(degree, 0.25) AS degree_q25, median(degree) AS degree_median, quantile_cont(degree, 0.75) AS degree_q75, count(*) FILTER (degree = 0) AS n_isolated, (SELECT median(distance) FROM nb WHERE rank = 1) AS median_nearest FROM dg",
    "edge_dedup": f"WITH {NEAR} SELECT DISTINCT least(src, dst) AS lo, greatest(src, dst) AS hi FROM nb",
    "connected_components": f"WITH RECURSIVE {POINTS}, ed AS (SELECT a.obs_id AS u, b.obs_id AS v FROM pt a JOIN pt b ON a.obs_id <> b.obs_id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {RADIUS / 2}), reach(obs_id, other) AS (SELECT obs_id, obs_id FROM pt UNION SELECT r.obs_id, v FROM reach r JOIN ed ON u = r.other) SELECT obs_id, min(other) AS component FROM reach GROUP BY obs_id",
    "coverage_pivot": f"WITH {ACC} SELECT dataset, count(*) FILTER (method = 'm1') AS m1, count(*) FILTER (method = 'm2') AS m2, count(*) FILTER (method = 'm3') AS m3, count(*) FILTER (method = 'm4') AS m4, count(*) FILTER (method = 'm5') AS m5 FROM acc GROUP BY dataset",
    "measure_pivot": f"WITH {UNITS} SELECT dataset, {', '.join(f'max({x}) FILTER (method = {chr(39)}{n}{chr(39)}) AS {x}__{n}' for x in ('median_reference_ari', 'instability') for n in _N)} FROM units GROUP BY dataset",
    "ordered_union": f"WITH {RUNS} SELECT n_name AS name, 'nation' AS kind, n_regionkey AS region FROM nation UNION ALL SELECT r_name, 'region', r_regionkey FROM region",
    "schema_align_union": "SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, 'customer' AS kind FROM customer UNION ALL SELECT s_name, s_acctbal, NULL, 'supplier' FROM supplier",
    "grid_missing": "WITH g AS (SELECT DISTINCT n_nationkey, c_mktsegment FROM nation, (SELECT DISTINCT c_mktsegment FROM customer)), h AS (SELECT DISTINCT c_nationkey AS n_nationkey, c_mktsegment FROM customer) SELECT n_nationkey, c_mktsegment, 'missing' AS problem FROM (SELECT * FROM g EXCEPT SELECT * FROM h) UNION ALL SELECT c_nationkey, c_mktsegment, 'repeated' FROM customer GROUP BY ALL HAVING count(*) > 1",
    "backfilter_diff": "WITH n AS (SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS s FROM orders), o AS (SELECT o_orderkey, o_orderstatus AS s FROM orders) SELECT *, 'left' AS side FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o) UNION ALL SELECT *, 'right' FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n)",
    "histogram_bins": "SELECT least(floor((l_discount - 0) / ((0.1 - 0) / 40)), 39) AS bin, count(*) AS n FROM lineitem WHERE l_discount BETWEEN 0 AND 0.1 GROUP BY ALL",
    "value_counts": "SELECT CAST(toxic AS VARCHAR) AS toxic, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL",
    "finite_summary": "SELECT o_orderpriority, count(o_totalprice) AS n, median(o_totalprice) AS median, quantile_cont(o_totalprice, 0.25) AS q25, quantile_cont(o_totalprice, 0.75) AS q75 FROM orders GROUP BY ALL",
    "cumulative_median": "WITH c AS (SELECT o_orderstatus, floor(o_totalprice / 1000) AS bin, count(*) AS n FROM orders GROUP BY ALL), d AS (SELECT *, sum(n) OVER (PARTITION BY o_orderstatus ORDER BY bin) AS cumulative, sum(n) OVER (PARTITION BY o_orderstatus) AS total FROM c) SELECT *, cumulative >= ceil(total / 2) AND cumulative - n < ceil(total / 2) AS is_median FROM d",
    "total_row": "SELECT coalesce(l_returnflag, 'TOTAL') AS l_returnflag, sum(cast(l_quantity AS BIGINT)) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag)",
    "joined_names": "SELECT r_name, string_agg(n_name, ';' ORDER BY n_nationkey, n_name) AS n_name FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "sha_digest": "WITH p AS (SELECT c_mktsegment, c_custkey // 1000 AS part, upper(sha256(string_agg(c_name, chr(10) ORDER BY c_custkey, c_name))) AS d FROM customer GROUP BY ALL) SELECT c_mktsegment, upper(sha256(string_agg(d, chr(10) ORDER BY part))) AS digest FROM p GROUP BY ALL",
    "json_flatten": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "strict_lookup": "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "audit_states": "SELECT doc_id, CASE WHEN quality IS NULL THEN 'absent' WHEN quality <> 1 THEN 'quality' WHEN toxic <> 0 THEN 'toxic' ELSE 'valid' END AS state FROM documents LEFT JOIN labels USING (doc_id)",
    "full_outer_audit": "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v <> b.v THEN 'changed' ELSE 'same' END AS status FROM (SELECT c_custkey AS k, c_nationkey AS v FROM customer) a FULL JOIN (SELECT s_suppkey AS k, s_nationkey AS v FROM supplier) b ON a.k = b.k",
    "top_per_group": "SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3",
    "unit_table": f"WITH {ISO} SELECT u.*, n_iso_pairs, median_partition_ari, n_divergent, n_divergent / nullif(n_iso_pairs, 0) AS divergent_fraction FROM units u JOIN isos USING (dataset, method) WHERE threshold = 0.02",
    "frequent_genes": f"WITH {MARK}, fq AS (SELECT dataset, method, domain, gene, count(*) / 20e0 AS frequency FROM mk WHERE rank <= 20 GROUP BY ALL), mf AS (SELECT dataset, method, gene, round(avg(frequency), 9) AS mean_frequency FROM fq GROUP BY ALL), tp AS (SELECT *, row_number() OVER (PARTITION BY dataset, method ORDER BY mean_frequency DESC, gene) AS rank FROM mf) SELECT dataset, method, gene, rank, mean_frequency, {', '.join(f'max(frequency) FILTER (domain = {k}) AS d{k}' for k in range(5))} FROM tp JOIN fq USING (dataset, method, gene) WHERE rank <= 18 GROUP BY ALL",
    "set_jaccard": "SELECT l_suppkey, count(*) FILTER (r AND a) AS shared, count(*) AS all_items, count(*) FILTER (r AND a) / count(*) AS jaccard FROM (SELECT l_suppkey, l_partkey, bool_or(l_returnflag = 'R') AS r, bool_or(l_returnflag = 'A') AS a FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY ALL) GROUP BY l_suppkey",
    "scalar_rules": "SELECT l_orderkey, l_linenumber, l_tax / nullif(l_discount, 0) AS ratio, CASE WHEN l_discount >= 0.08 THEN 'high' WHEN l_discount <= 0.02 THEN 'low' ELSE 'intermediate' END AS class, abs(l_discount - l_tax) <= 0.02 + 1e-12 AS iso, l_discount BETWEEN 0.03 AND 0.05 AS inside, starts_with(l_returnflag, 'R') AS returned FROM lineitem",
}
ORACLES["stable_unstable"] = f"""WITH {ORACLES["stable_control"].removeprefix("WITH ").rpartition(" SELECT * FROM (SELECT *, gap")[0]}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, method ORDER BY CASE WHEN gap <= 0.002 + 1e-12 THEN 0 ELSE 1 END, CASE WHEN gap <= 0.002 + 1e-12 THEN 0 ELSE gap END, stable_ari DESC, stable_r, stable_s) AS k FROM j) WHERE k = 1),
 fam AS (SELECT dataset AS family, count(*) AS n, median(unstable_ari) AS unstable_median, median(stable_ari) AS stable_median, median(stable_ari) - median(unstable_ari) AS gap FROM best GROUP BY dataset) SELECT *, (SELECT count(*) FILTER (gap >= 0.1) >= 2 FROM fam) AS triggered FROM fam"""
ORACLES["four_method_ranks"] = f"WITH {_FOUR} " + " UNION ALL ".join(f"SELECT dataset, '{_N[i - 1]}' AS method, 2 + 2 * (" + " + ".join(f"(s{j} > s{i})::INT" for j in range(1, 5) if j != i) + ") + " + " + ".join(f"(s{j} = s{i})::INT" for j in range(1, 5) if j != i) + " AS rank_x2, count(*) AS combos FROM four GROUP BY ALL" for i in range(1, 5))

ORACLES |= {
    "matrix_market": "SELECT n_nationkey + 1 AS row_number, n_nationkey + 1 AS column_number, n_nationkey + 1 AS value FROM nation",
    "graph_audit": """WITH g AS (SELECT CASE WHEN c_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)
 SELECT dataset, sum(n) AS n_vertices, sum(n - 1) AS n_edges, min(CASE WHEN n = 1 THEN 0 ELSE 1 END) AS min_degree, max(CASE WHEN n = 1 THEN 0 WHEN n = 2 THEN 1 ELSE 2 END) AS max_degree, count(*) FILTER (n = 1) AS n_isolated, count(*) AS n_components FROM g GROUP BY dataset""",
    "table_digest": """WITH r AS (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS c, o_orderkey AS k, sha256('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","o_totalprice":' || o_totalprice::DOUBLE || '}') AS d FROM orders),
 h AS (SELECT c, count(*) AS n, upper(sha256(string_agg(d, chr(10) ORDER BY k))) AS d FROM r GROUP BY c) SELECT sum(n) AS n_rows, upper(sha256(string_agg(d, chr(10) ORDER BY c))) AS digest FROM h""",
    "full_outer_nulls": """SELECT coalesce(c.c_custkey, s.s_suppkey) AS k, CASE WHEN c.c_custkey IS NULL THEN 'removed' WHEN s.s_suppkey IS NULL THEN 'added'
 WHEN CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey END IS NOT DISTINCT FROM CASE WHEN c_custkey % 2 > 0 THEN c_nationkey END THEN 'same' ELSE 'changed' END AS status FROM supplier s FULL JOIN customer c ON c_custkey = s_suppkey""",
    "not_finite": """SELECT 'x' AS "column", count(*) FILTER (o_orderkey % 7 = 0 OR o_totalprice / (o_orderkey % 7) > 1) AS n_bad FROM orders UNION ALL SELECT 'y', count(*) FILTER (o_totalprice / 1e5 > 1) FROM orders""",
    "row_count_audit": "SELECT 'region' AS name, count(*) AS n, 6 AS expected FROM region",
    "rank_sum_audit": f"""WITH {RANK} SELECT dataset, 'combinations' AS rule, sum(combos)::DOUBLE AS value FROM rd WHERE NOT (method = 'm2' AND rank_x2 = 6) GROUP BY dataset, method HAVING sum(combos) <> 3200000
 UNION ALL SELECT dataset, 'credit', sum(credit)::DOUBLE FROM (SELECT dataset, CASE WHEN dataset = 'O' THEN 2 * credit ELSE credit END AS credit FROM wp) GROUP BY dataset HAVING sum(credit) <> 192000000
 UNION ALL SELECT dataset, 'probability', sum(p) FROM (SELECT dataset, CASE WHEN dataset = 'F' THEN 2 * p_rank1 ELSE p_rank1 END AS p FROM wp) GROUP BY dataset HAVING abs(sum(p) - 1) > 1e-9""",
    "reconcile_units": f"""WITH {UNITS} SELECT dataset, method, 'instability' AS "column", instability AS "left", CASE WHEN method = 'm3' THEN instability + 0.1 END AS "right" FROM units WHERE method IN ('m3', 'm5')""",
    "names_by_dimension": "SELECT DISTINCT n_nationkey, lower(n_name) AS n_name, n_name AS canonical FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE (c_custkey + n_nationkey) % 10 = 0",
    "not_constant": "SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_values FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderstatus) > 1",
    "forbidden_tokens": "SELECT * FROM (SELECT 'licensed' AS name, count(*) FILTER (regexp_matches(text, '(?i)licensed under')) AS n_lines FROM documents UNION ALL SELECT 'never', count(*) FILTER (regexp_matches(text, 'no such token 123')) FROM documents) WHERE n_lines > 0",
    "schema_audit": "SELECT 'missing o_absent' AS problem, count(*) AS n FROM orders UNION ALL SELECT 'null in o_clerk', count(*) FROM orders WHERE o_orderkey % 9 = 0",
    "text_rules": """SELECT c_custkey, c_name LIKE 'Customer#%' AS customer, replace(c_name, 'Customer#', '') AS bare, CAST(replace(c_name, 'Customer#', '') AS DOUBLE) AS number, CAST(NULL AS DOUBLE) AS no_number, 'x' || chr(8722) || c_custkey AS canonical,
 true AS good_digest, false AS bad_digest, c_custkey % 2 = 0 AS flag, epoch(TIMESTAMP '2020-01-01 00:00:00') + 86400 * (c_custkey % 9) AS seconds, 0.01 AS snapped, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' ELSE c_mktsegment END AS mapped FROM customer""",
    "first_per_group": "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1",
    "without_pairs": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "repeatability": f"""WITH {RUNS}, rc AS (SELECT r.dataset, r.method, CASE WHEN r.method = 'm2' THEN s.cluster ELSE (r.cluster + 1) % {K} END AS b, r.cluster AS a, count(*) AS n FROM runs r JOIN runs s ON r.dataset = s.dataset AND r.method = s.method AND r.obs_id = s.obs_id AND r.seed = 1 AND s.seed = 2 GROUP BY ALL),
 {agree("rp", "rc", "dataset, method")} SELECT dataset, method, n_obs, ari, nmi, ari = 1 AS identical FROM rp""",
    "discordance": f"SELECT o_orderstatus AS dataset, 'm' AS method, o_orderkey AS obs_id, CAST(ref AS VARCHAR) AS \"right\", CAST(((c + 4) * 3) % 5 AS VARCHAR) AS \"left\", ((c + 4) * 3) % 5 <> ref AS discordant FROM (SELECT *, (ref * 2 + 1 + (o_orderkey % 32 = 0)::INT) % 5 AS c FROM (SELECT *, ascii(o_orderpriority) % {K} AS ref FROM orders))",
    "csv_round_trip": "SELECT c_custkey, c_name, c_acctbal FROM customer",
    "tsv_round_trip": "SELECT c_custkey, c_name, c_acctbal FROM customer",
    "headerless_round_trip": "SELECT c_custkey, c_name, c_acctbal FROM customer",
    "token_round_trip": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier",
    "json_summary": "SELECT count(*) AS n, max(o_orderpriority) AS last, count(DISTINCT o_custkey) AS customers FROM orders",
    "file_manifest": """WITH n AS (SELECT c_nationkey AS nation, bool_or(c_nationkey % 4 <> 0 AND c_custkey % 5 = 0) AS hit FROM customer GROUP BY ALL)
 SELECT nation, CASE WHEN nation = 3 THEN 'removed' WHEN hit THEN 'changed' ELSE 'same' END AS status FROM n UNION ALL SELECT 26, 'added' FROM n WHERE nation = 5""",
    "published_tables": "SELECT 'orders_' || o_orderstatus AS name, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN -o_totalprice ELSE o_totalprice END AS o_totalprice FROM orders",
    "neighbour_mean": f"WITH {SPACE} SELECT 'e' AS dataset, src AS obs_id, gene, value FROM nm",
    "neighbour_matrix": f"""WITH {SPACE}, np AS (SELECT count(*) AS n FROM pt), sd AS (SELECT part, gene, sqrt(v) AS sd FROM (SELECT part, gene, sum(value * value) / max(n) - (sum(value) / max(n)) * (sum(value) / max(n)) AS v FROM (SELECT 'own' AS part, gene, value FROM ve UNION ALL SELECT 'neighbours', gene, value FROM nm), np GROUP BY ALL)),
 ok AS (SELECT gene FROM sd WHERE sd * sd > 1e-12 GROUP BY gene HAVING count(*) = 2)
 SELECT 'e' AS dataset, obs_id, x.part, x.gene, value * CASE x.part WHEN 'own' THEN sqrt(0.8e0) ELSE sqrt(0.2e0) END / sd AS value FROM (SELECT obs_id, 'own' AS part, gene, value FROM ve UNION ALL SELECT src, 'neighbours', gene, value FROM nm) x JOIN sd ON sd.part = x.part AND sd.gene = x.gene WHERE x.gene IN (SELECT gene FROM ok)""",
    "variable_genes": f"""WITH {EXPR}, nn AS (SELECT dataset, count(*) AS n FROM ob GROUP BY ALL), gm AS (SELECT dataset, gene, n, sum(value) / n AS mean, (sum(value * value) - sum(value) * sum(value) / n) / (n - 1) AS variance FROM ex JOIN nn USING (dataset) GROUP BY dataset, gene, n),
 lg AS (SELECT dataset, gene, log10(mean) AS x, log10(variance) AS y, ceil(0.3 * count(*) OVER (PARTITION BY dataset)) AS k FROM gm WHERE variance > 0 AND mean > 0),
 pr AS (SELECT a.dataset, a.gene, b.x - a.x AS dx, b.y, a.k, row_number() OVER (PARTITION BY a.dataset, a.gene ORDER BY abs(b.x - a.x)) AS r FROM lg a JOIN lg b ON a.dataset = b.dataset),
 wi AS (SELECT dataset, gene, dx / h AS u, pow(1 - pow(abs(dx) / h, 3), 3) AS w, y FROM (SELECT *, max(abs(dx)) FILTER (r <= k) OVER (PARTITION BY dataset, gene) AS h FROM pr) WHERE abs(dx) < h),
 su AS (SELECT dataset, gene, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * u * u * u) AS s3, sum(w * u * u * u * u) AS s4, sum(w * y) AS t0, sum(w * u * y) AS t1, sum(w * u * u * y) AS t2 FROM wi GROUP BY ALL),
 ft AS (SELECT dataset, gene, pow(10, (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2))) AS e FROM su),
 cl AS (SELECT dataset, gene, sum(least(value, sqrt(e * n) + mean)) AS s, sum(pow(least(value, sqrt(e * n) + mean), 2)) AS q FROM ex JOIN gm USING (dataset, gene) JOIN ft USING (dataset, gene) GROUP BY ALL),
 sc AS (SELECT dataset, gene, (n * mean * mean + q - 2 * mean * s) / ((n - 1) * e) AS score FROM cl JOIN gm USING (dataset, gene) JOIN ft USING (dataset, gene))
 SELECT * FROM (SELECT dataset, gene, round(score, 6) AS score, row_number() OVER (PARTITION BY dataset ORDER BY round(score, 9) DESC, gene) AS k FROM sc) WHERE k <= 40""",
    "checkpoint_audit": """SELECT o_orderkey, 'value' AS rule, '$.status' AS path FROM orders WHERE o_orderkey % 13 = 0 UNION ALL SELECT o_orderkey, 'required', '$.mode' FROM orders WHERE o_orderkey % 37 = 0
 UNION ALL SELECT o_orderkey, 'range', '$.seed' FROM orders WHERE o_orderkey % 17 = 0 UNION ALL SELECT o_orderkey, 'pattern', '$.protocol_hash' FROM orders WHERE o_orderkey % 19 = 0 UNION ALL SELECT o_orderkey, 'same', '$.final_readout.labels_count' FROM orders WHERE o_orderkey % 23 = 0
 UNION ALL SELECT o_orderkey, 'range', '$.training.embedding_shape[1]' FROM orders WHERE o_orderkey % 29 = 0 UNION ALL SELECT o_orderkey, 'range', '$.runtime_seconds' FROM orders WHERE o_orderkey % 31 = 0
 UNION ALL SELECT o_orderkey, 'range', unnest(['$.input.obs_count', '$.training.embedding_shape[0]']) FROM orders WHERE o_custkey < 1""",
    "checkpoint_table": """SELECT o_orderstatus AS dataset, CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE o_orderkey % 20 + 1 END AS seed, CASE WHEN o_orderkey % 13 = 0 THEN o_orderstatus ELSE 'complete' END AS status, CASE WHEN o_orderkey % 37 <> 0 THEN 'm' END AS mode, 5 AS requested_k, 5 - o_custkey % 2 AS observed_k,
 o_custkey AS n_obs, o_custkey % 100 + 1 AS n_vars, 7 AS retained_gene_count, 3 AS pca_dimension, 6 AS graph_k, o_custkey * 3 AS graph_edge_count, 0 AS graph_isolates, 1 AS graph_connected_components, sha256(o_orderpriority) AS graph_sha256, 2 AS pretraining_epochs_completed, 2 AS dec_epochs_completed,
 o_custkey || 'x' || CASE WHEN o_orderkey % 29 = 0 THEN 0 ELSE 3 END AS embedding_shape, true AS embedding_finite, CASE WHEN o_orderkey % 23 = 0 THEN o_custkey + 1 ELSE o_custkey END AS labels_count, true AS labels_finite, 'EEE' AS final_readout_model, 1 AS final_readout_calls,
 CASE WHEN o_orderkey % 31 = 0 THEN -1 ELSE o_totalprice / 4 END AS runtime_seconds, 0.5 AS peak_ram_gib, CAST(NULL AS DOUBLE) AS peak_gpu_memory_mib, CASE WHEN o_orderkey % 19 = 0 THEN substr(sha256(o_orderpriority), 2) ELSE sha256(o_orderpriority) END AS protocol_sha256, sha256(o_orderpriority) AS input_sha256, sha256(o_orderpriority) AS input_manifest_sha256, sha256(o_orderpriority) AS labels_sha256, upper(sha256(o_orderkey::VARCHAR)) AS checkpoint_sha256 FROM orders""",
    "canonical_orders": """WITH i AS (SELECT l_orderkey, string_agg('{"line":' || l_linenumber || ',"price":' || l_extendedprice::DOUBLE || '}', ',' ORDER BY l_linenumber, l_extendedprice) AS items FROM lineitem GROUP BY ALL)
 SELECT o_orderkey, upper(sha256('{"about":{"Kind":"' || chr(92) || 'u00e9","status":"' || o_orderstatus || '"},"items":[' || items || '],"total":' || o_totalprice::DOUBLE || '}')) AS digest FROM orders JOIN i ON l_orderkey = o_orderkey""",
    "array_round_trip": "SELECT o_orderkey, o_custkey, o_orderkey % 7 AS rest FROM orders",
    "price_quantiles": "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.05) AS p05, median(l_extendedprice) AS median, quantile_cont(l_extendedprice, 0.99) AS p99, median(l_quantity) FILTER (l_linenumber > 1) AS quantity FROM lineitem GROUP BY ALL",
    "price_ranks": f"SELECT l_orderkey, l_linenumber, {midrank('', 'l_quantity')} AS overall, {midrank('l_returnflag', 'l_extendedprice')} AS within FROM lineitem",
    "boundary_support": f"WITH {NEAR}, bf AS (SELECT src, coalesce(bool_or(a.label <> b.label), false) AS f FROM nb JOIN pt a ON a.obs_id = src JOIN pt b ON b.obs_id = dst GROUP BY src) SELECT 'e' AS dataset, median(CASE WHEN f THEN (src % 100) / 100e0 END) AS boundary_median, median(CASE WHEN NOT f THEN (src % 100) / 100e0 END) AS inner_median, count(*) FILTER (f) AS n_boundary FROM bf",
    "ranking_table": f"""WITH {RANK}, {MPAIR.replace(f"{RUNS}, ", "", 1).replace(f"{_ACC}, ", "", 1)}, cu AS (SELECT *, sum(combos) OVER (PARTITION BY dataset, method ORDER BY rank_x2) AS cum, sum(combos) OVER (PARTITION BY dataset, method) AS n FROM rd),
 rt AS (SELECT dataset, method, sum(combos * rank_x2) / 2e0 / max(n) AS expected_rank FROM cu GROUP BY ALL),
 co AS (SELECT dataset, method, corr(x, y) AS spearman FROM (SELECT dataset, method, {midrank('dataset, method', 'partition_ari')} AS x, {midrank('dataset, method', 'jaccard')} AS y FROM (SELECT * REPLACE (round(jaccard, 9) AS jaccard) FROM prm WHERE jaccard IS NOT NULL)) GROUP BY ALL),
 tm AS (SELECT dataset, method, median(jaccard) FILTER (tertile = 'Low') AS low, median(jaccard) FILTER (tertile = 'Middle') AS middle, median(jaccard) FILTER (tertile = 'High') AS high FROM ter GROUP BY ALL)
 SELECT * FROM rt JOIN co USING (dataset, method) JOIN tm USING (dataset, method)""",
    "landscape": "SELECT o_orderstatus AS dataset, count(*) AS n_obs, 'm1;m2;m3;m4;m5' AS methods, 100 AS valid_runs, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'fulfilled' ELSE o_orderstatus END AS dataset_display FROM orders GROUP BY ALL",
    "noted_texts": "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'HBCA1' ELSE c_mktsegment END AS source, 'Bregma ' || CASE WHEN c_nationkey::VARCHAR LIKE '1%' THEN chr(8722) ELSE '-' END || c_nationkey || CASE WHEN c_mktsegment = 'BUILDING' THEN ' (pathology)' ELSE '' END AS section FROM customer",
    "map_union": f"WITH {RUNS} SELECT a.dataset AS section, a.method, a.obs_id AS observation_id, a.cluster AS seed_a_domain, b.cluster AS seed_b_domain, a.ref AS reference, a.cluster <> b.cluster AS discordant FROM runs a JOIN runs b ON a.dataset = b.dataset AND a.method = b.method AND a.obs_id = b.obs_id AND a.seed = 1 AND b.seed = 2 WHERE a.method IN ('m1', 'm2')",
    "control_table": f"""WITH {RUNS}, rc AS (SELECT r.dataset, r.method, 'rerun' AS control, r.cluster AS a, s.cluster AS b, count(*) AS n FROM runs r JOIN runs s ON r.dataset = s.dataset AND r.method = s.method AND r.obs_id = s.obs_id AND r.seed = 1 AND s.seed = 2 WHERE r.dataset = 'O' GROUP BY ALL
 UNION ALL SELECT dataset, method, 'relabelled', cluster, (cluster + 2) % {K}, count(*) FROM runs WHERE seed = 1 AND method = 'm1' AND dataset = 'O' GROUP BY ALL), {agree("rp", "rc", "dataset, method, control")}
 SELECT row_number() OVER (ORDER BY control = 'relabelled', method = 'm5', method) AS display_order, method, dataset, control, ari, CASE WHEN method <> 'm5' THEN nmi END AS nmi, CASE control WHEN 'rerun' THEN 'identical_seed_rerun' ELSE 'label_permutation_sanity' END AS control_type FROM rp""",
    "scope": f"WITH {ACC}, c AS (SELECT *, CASE dataset WHEN 'F' THEN 'closed' ELSE 'running' END AS context FROM acc) SELECT context, count(DISTINCT dataset) AS datasets, count(DISTINCT dataset || method) AS units, count(*) AS runs FROM c GROUP BY ALL UNION ALL SELECT 'TOTAL', count(DISTINCT dataset), count(DISTINCT dataset || method), count(*) FROM c",
    "four_method_uncertainty": f"""WITH {_FOUR}, fl AS ({" UNION ALL ".join(f"SELECT dataset, 'm{i}' AS method, " + " + ".join(f"(s{j} > s{i})::INT" for j in range(1, 5) if j != i) + " AS g, " + " + ".join(f"(s{j} = s{i})::INT" for j in range(1, 5) if j != i) + " AS t, count(*) AS c FROM four GROUP BY ALL" for i in range(1, 5))}),
 fw AS (SELECT dataset, method, sum(CASE WHEN g = 0 THEN c * 12 // (t + 1) ELSE 0 END) AS credit, sum(CASE WHEN g = 0 THEN c * 12 // (t + 1) ELSE 0 END) / (sum(c) * 12) AS p_rank1 FROM fl GROUP BY ALL)
 SELECT dataset, sum(credit) AS credit_sum, max(p_rank1) AS max_p_rank1, string_agg(method, ';' ORDER BY method) FILTER (credit = best) AS most_probable_winner, count(*) FILTER (p_rank1 > 0) AS n_positive, count(*) FILTER (p_rank1 >= 0.05) AS n_at_least_5_percent, -sum(CASE WHEN p_rank1 > 0 THEN p_rank1 * log2(p_rank1) ELSE 0 END) AS entropy_bits, -sum(CASE WHEN p_rank1 > 0 THEN p_rank1 * log2(p_rank1) ELSE 0 END) / 2 AS entropy_normalized FROM (SELECT *, max(credit) OVER (PARTITION BY dataset) AS best FROM fw) GROUP BY dataset""",
    "marker_universe": f"WITH {EXPR}, g AS (SELECT dataset, gene, count(*) >= 100 AS flagged FROM ex GROUP BY ALL), u AS (SELECT dataset, count(*) FILTER (flagged) AS n FROM g GROUP BY ALL) SELECT dataset, 'empty' AS problem, n FROM u WHERE n = 0 UNION ALL SELECT dataset, 'too few', n FROM u WHERE n BETWEEN 1 AND 99 UNION ALL SELECT dataset, 'not 155', n FROM u WHERE dataset = 'P' AND n <> 155 UNION ALL SELECT dataset, 'not 120', n FROM u WHERE dataset = 'F' AND n <> 120",
    "embedding_difference": "WITH d AS (SELECT abs((embedding[g]::DOUBLE + CASE WHEN vec_id % 7 = 0 THEN (g - 1) / 1024e0 ELSE 0e0 END) - embedding[g]::DOUBLE) AS x FROM embeddings, range(1, 65) AS r(g)) SELECT max(x) AS max_abs, avg(x) AS mean_abs, max(x) <= 1e-6 AS all_close FROM d",
    "release_audit": f"""WITH {ISO}, u AS (SELECT count(*) AS n, count(DISTINCT dataset) * count(DISTINCT method) AS g FROM units), f AS (SELECT count(*) FILTER (threshold = 0.02) AS one, sum(n_divergent) FILTER (threshold = 0.02) AS dv, sum(n_iso_pairs) FILTER (threshold = 0.02) AS el, count(*) AS c FROM isos),
 c("check", expected, found) AS (SELECT 'units are a grid', g, n FROM u UNION ALL SELECT 'seeds', n * 20, (SELECT count(*) FROM acc) FROM u UNION ALL SELECT 'full units of seeds', n, (SELECT count(*) FROM (SELECT 1 FROM acc GROUP BY dataset, method HAVING count(*) = 20)) FROM u
  UNION ALL SELECT 'pairs', n * 190, (SELECT count(*) FROM pr) FROM u UNION ALL SELECT 'full units of pairs', n, (SELECT count(*) FROM (SELECT 1 FROM pr GROUP BY dataset, method HAVING count(*) = 190)) FROM u UNION ALL SELECT 'thresholds', n * 3, c FROM u, f UNION ALL SELECT 'primary threshold', n, one FROM u, f
  UNION ALL SELECT 'divergent flags', 0, 0 UNION ALL SELECT 'divergent pairs are eligible', least(dv, el), dv FROM f) SELECT *, expected = found AS passed FROM c""",
}
