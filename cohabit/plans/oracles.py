"""DuckDB SQL of the study's queries, in the direct form (counts of distinct datasets, pairwise comparisons)."""

from __future__ import annotations

from cohabit.config import COMPARISONS, LEAST_P, PRIORITY, THRESHOLDS
from cohabit.plans.queries import STUDY
from cohabit.sources.fixtures import DUCKDB


def _values(thresholds: tuple[float, ...]) -> str:
    return "t AS (SELECT unnest([" + ", ".join(f"CAST({t!r} AS DOUBLE)" for t in thresholds) + "]) AS threshold)"


def _grid(thresholds: tuple[float, ...]) -> str:
    return f"""{DUCKDB},
{_values(thresholds)},
hids AS (SELECT DISTINCT host_tax_id FROM fx_meta), mids AS (SELECT DISTINCT path_tax_id FROM fx_meta),
hc AS (SELECT host_tax_id, threshold AS host_threshold, count(DISTINCT CASE WHEN total_abundance >= threshold THEN acc END) AS host_dataset_count
       FROM hids CROSS JOIN t LEFT JOIN fx_host ON tax_id = host_tax_id GROUP BY ALL),
mc AS (SELECT path_tax_id, threshold AS path_threshold, count(DISTINCT CASE WHEN total_abundance >= threshold THEN acc END) AS pathogen_dataset_count
       FROM mids CROSS JOIN t LEFT JOIN fx_microbe ON tax_id = path_tax_id GROUP BY ALL),
pa AS (SELECT h.tax_id AS ht, m.tax_id AS mt, h.acc, h.total_abundance AS ha, m.total_abundance AS ma FROM fx_host h JOIN fx_microbe m ON h.acc = m.acc),
jc AS (SELECT host_tax_id, path_tax_id, t1.threshold AS host_threshold, t2.threshold AS path_threshold,
              count(DISTINCT CASE WHEN ha >= t1.threshold AND ma >= t2.threshold THEN acc END) AS both_dataset_count
       FROM hids CROSS JOIN mids CROSS JOIN t t1 CROSS JOIN t t2 LEFT JOIN pa ON ht = host_tax_id AND mt = path_tax_id GROUP BY ALL),
grid AS (SELECT host_tax_id, path_tax_id, host_threshold, path_threshold, host_dataset_count, pathogen_dataset_count, both_dataset_count
         FROM jc JOIN hc USING (host_tax_id, host_threshold) JOIN mc USING (path_tax_id, path_threshold)),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM orders)"""


_RANK = " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(PRIORITY))
_LABELS = f"""lab AS (SELECT host_tax_id, path_tax_id, Interaction_type FROM (SELECT *, row_number() OVER (PARTITION BY host_tax_id, path_tax_id
        ORDER BY CASE Interaction_type {_RANK} ELSE 99 END, Interaction_type) AS k FROM fx_meta) WHERE k = 1),
lgrid AS (SELECT grid.*, coalesce(Interaction_type, 'Random') AS Interaction_type FROM grid LEFT JOIN lab USING (host_tax_id, path_tax_id)),
samp AS (SELECT host_tax_id, path_tax_id, Interaction_type FROM (SELECT *, row_number() OVER (PARTITION BY Interaction_type
        ORDER BY md5('{STUDY.seed}|' || Interaction_type || '|' || host_tax_id || '|' || path_tax_id), host_tax_id, path_tax_id) AS k
        FROM (SELECT DISTINCT host_tax_id, path_tax_id, Interaction_type FROM lgrid)) WHERE k <= {STUDY.sample_n})"""
_ODDS = "log2((both_dataset_count / n + 1 / n) / ((host_dataset_count / n) * (pathogen_dataset_count / n) + 1 / n))"
_KEYS = "host_tax_id, path_tax_id, round(host_threshold, 9) AS host_threshold, round(path_threshold, 9) AS path_threshold, host_dataset_count, pathogen_dataset_count, both_dataset_count"


def _classes(rows: tuple, sampled: bool = True) -> str:
    values = ", ".join(str(r) for r in rows)
    chosen = "JOIN samp USING (host_tax_id, path_tax_id, Interaction_type)" if sampled else ""
    return f"""cmp(comparison, pos_class, neg_class) AS (VALUES {values}),
sc AS (SELECT comparison, host_threshold, path_threshold, round({_ODDS}, 9) AS s, CASE WHEN Interaction_type = pos_class THEN 1 ELSE 0 END AS pos
       FROM lgrid {chosen} CROSS JOIN n JOIN cmp ON Interaction_type IN (pos_class, neg_class)),
side AS (SELECT comparison, host_threshold, path_threshold, sum(pos) AS np, sum(1 - pos) AS nn,
         CASE WHEN median(CASE WHEN pos = 0 THEN s END) <= median(CASE WHEN pos = 1 THEN s END) THEN 1 ELSE -1 END AS sign FROM sc GROUP BY ALL HAVING sum(pos) > 0 AND sum(1 - pos) > 0),
x AS (SELECT comparison, host_threshold, path_threshold, s * sign AS s, pos, np, nn, sign FROM sc JOIN side USING (comparison, host_threshold, path_threshold)),
auc AS (SELECT a.comparison, a.host_threshold, a.path_threshold, avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END) AS auc
        FROM x a JOIN x b USING (comparison, host_threshold, path_threshold) WHERE a.pos = 1 AND b.pos = 0 GROUP BY ALL)"""


def _auc(rows: tuple, sampled: bool = True, ties: str = "row_number") -> str:
    last = ", tp DESC" if ties == "row_number" else ""
    return f"""{_grid(THRESHOLDS)}, {_LABELS}, {_classes(rows, sampled)},
cut AS (SELECT DISTINCT comparison, host_threshold, path_threshold, s AS c FROM x UNION SELECT DISTINCT comparison, host_threshold, path_threshold, CAST('-inf' AS DOUBLE) FROM x),
pt AS (SELECT cut.comparison, cut.host_threshold, cut.path_threshold, c, any_value(np) AS np, any_value(nn) AS nn, sum(CASE WHEN pos = 1 AND s > c THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN pos = 0 AND s <= c THEN 1 ELSE 0 END) AS tn
       FROM cut JOIN x USING (comparison, host_threshold, path_threshold) GROUP BY ALL),
best AS (SELECT comparison, host_threshold, path_threshold, tp + tn AS n_correct FROM (SELECT *, {ties}() OVER (PARTITION BY comparison, host_threshold, path_threshold ORDER BY tp * nn + tn * np DESC{last}) AS k FROM pt) WHERE k = 1),
cnt AS (SELECT comparison, host_threshold, path_threshold, count(*) AS n_total FROM sc GROUP BY ALL),
res AS (SELECT comparison, round(host_threshold, 9) AS host_threshold, round(path_threshold, 9) AS path_threshold, auc, CAST(coalesce(n_total, 0) AS BIGINT) AS n_total, CAST(n_correct AS BIGINT) AS n_correct
        FROM (SELECT DISTINCT host_threshold, path_threshold FROM grid) CROSS JOIN (SELECT comparison FROM cmp) LEFT JOIN cnt USING (comparison, host_threshold, path_threshold)
        LEFT JOIN auc USING (comparison, host_threshold, path_threshold) LEFT JOIN best USING (comparison, host_threshold, path_threshold))"""


_ONE = (("PHI vs Neg", "PHI-Base", "Negative Control"),)
_SIGN = "CASE WHEN substr(md5(CAST({key} AS VARCHAR) || '#' || CAST(d // 32 AS VARCHAR)), CAST(d % 32 + 1 AS BIGINT), 1) < '8' THEN -1 ELSE 1 END"


def _embedding(of: str, over: str, shown: str = "round({}, 6) + 0.0") -> str:
    value = shown.format(f"(sum(total_abundance * {_SIGN.format(key=over)}) / sqrt({STUDY.dims}))")
    return f"""{DUCKDB} SELECT {of}, CAST(d AS INTEGER) AS dim, {value} AS value
FROM fx_abundance CROSS JOIN range({STUDY.dims}) r(d) GROUP BY {of}, d"""


_LC = "(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"


def _pmf(x: str, white: str, black: str, draws: str) -> str:
    return f"exp({_LC.format(n=white, k=x)} + {_LC.format(n=black, k=f'({draws} - {x})')} - {_LC.format(n=f'({white} + {black})', k=draws)})"


def _margins(n: str) -> str:
    """k: distinct counts; mg: distinct margins, their support and the range of shared counts; pm: probabilities of each margin wherever they count."""
    return f"""k AS (SELECT DISTINCT host_dataset_count AS h, pathogen_dataset_count AS m, both_dataset_count AS s, {n} AS n FROM grid CROSS JOIN n),
mg AS (SELECT h, m, n, greatest(0, m - (n - h)) AS lo, least(h, m) AS hi, min(s) AS s0, max(s) AS s1, m * h / n AS mu, sqrt(greatest(1, m * h / n * (1 - h / n) * (n - m) / (n - 1))) AS sd FROM k GROUP BY ALL),
pm AS (SELECT h, m, x, {_pmf("x", "h", "(n - h)", "m")} AS q
       FROM (SELECT *, unnest(range(CAST(greatest(lo, least(s0, floor(mu - 12 * sd - 40))) AS BIGINT), CAST(least(hi, greatest(s1 + 5 * sd + 40, ceil(mu + 12 * sd + 40))) AS BIGINT) + 1)) AS x FROM mg))"""


_PAIRS = "px AS (SELECT DISTINCT host_tax_id, microbe_tax_id, unnest(SRA_datasets) AS acc FROM fx_pairs_lists)"
_ABUND = f"""{DUCKDB}, {_PAIRS},
pr AS (SELECT host_tax_id, microbe_tax_id, max(CASE WHEN tax_id = host_tax_id THEN total_abundance END) AS host_abundance, max(CASE WHEN tax_id = microbe_tax_id THEN total_abundance END) AS microbe_abundance, px.acc AS SRA_accession
       FROM px LEFT JOIN fx_abundance d ON d.acc = px.acc AND (d.tax_id = host_tax_id OR d.tax_id = microbe_tax_id) GROUP BY ALL
       HAVING max(CASE WHEN tax_id = host_tax_id THEN total_abundance END) IS NOT NULL OR max(CASE WHEN tax_id = microbe_tax_id THEN total_abundance END) IS NOT NULL)"""
_SRA = "acc, platform, center, strftime(releasedate, '%Y-%m-%d') AS releasedate"

ORACLES: dict[str, str] = {
    "alpha_diversity": f"""{DUCKDB}, f AS (SELECT acc, tax_id, sum(total_abundance) AS x FROM fx_abundance WHERE total_abundance > 0 GROUP BY ALL),
s AS (SELECT acc, sum(x) AS t, sum(x * ln(x)) AS a, sum(x * x) AS b, max(x) AS m, count(*) AS richness FROM f GROUP BY acc)
SELECT acc, richness, round(a / t - ln(t), 9) AS shannon, round(1 - b / (t * t), 9) AS "simpson_1_minus_D", round(t * t / b, 9) AS inverse_simpson,
 round(CASE WHEN richness > 1 THEN (a / t - ln(t)) / ln(richness) END, 9) AS pielou_evenness, round(m / t, 9) AS berger_parker_dominance, substr(acc, 1, 5) AS acc_prefix,
 round(-(a / t - ln(t)), 9) AS shannon_entropy, round(CASE WHEN richness > 1 THEN -(a / t - ln(t)) / ln(richness) END, 9) AS pielou_j FROM s""",
    "host_threshold_counts": f"{_grid(THRESHOLDS)} SELECT host_tax_id AS tax_id, host_threshold AS threshold, host_dataset_count AS n FROM hc",
    "microbe_threshold_counts": f"{_grid(THRESHOLDS)} SELECT path_tax_id AS tax_id, path_threshold AS threshold, pathogen_dataset_count AS n FROM mc",
    "pair_abundances": f"{_grid(THRESHOLDS)} SELECT ht AS host_tax_id, mt AS path_tax_id, count(*) AS n_rows, count(DISTINCT acc) AS n_acc, round(max(ha), 6) AS max_host, round(max(ma), 6) AS max_path FROM pa WHERE ht IN (FROM hids) AND mt IN (FROM mids) GROUP BY ALL",
    "joint_threshold_counts": f"{_grid(THRESHOLDS)} SELECT * FROM jc",
    "threshold_summary": f"{_grid(THRESHOLDS)} SELECT * FROM grid",
    "expected_rows": f"{DUCKDB} SELECT CAST(count(DISTINCT host_tax_id) * count(DISTINCT path_tax_id) * 900 AS BIGINT) AS expected_rows FROM fx_meta",
    "listed_pair_shared_counts": f"""{_grid(THRESHOLDS)},
k AS (SELECT DISTINCT path_tax_id, pathogen_root_label FROM fx_meta),
ml AS (SELECT path_tax_id, pathogen_root_label, threshold AS path_threshold, count(DISTINCT CASE WHEN total_abundance >= threshold THEN acc END) AS c
       FROM k CROSS JOIN t LEFT JOIN fx_microbe ON tax_id = path_tax_id AND pathogen_type = pathogen_root_label GROUP BY ALL),
pl AS (SELECT h.tax_id AS ht, m.tax_id AS mt, m.pathogen_type AS lt, h.acc, h.total_abundance AS ha, m.total_abundance AS ma FROM fx_host h JOIN fx_microbe m ON h.acc = m.acc),
jl AS (SELECT p.host_tax_id, p.path_tax_id, p.pathogen_root_label, t1.threshold AS host_threshold, t2.threshold AS path_threshold, count(DISTINCT CASE WHEN ha >= t1.threshold AND ma >= t2.threshold THEN acc END) AS c
       FROM (SELECT DISTINCT host_tax_id, path_tax_id, pathogen_root_label FROM fx_meta) p CROSS JOIN t t1 CROSS JOIN t t2 LEFT JOIN pl ON ht = p.host_tax_id AND mt = p.path_tax_id AND lt = p.pathogen_root_label GROUP BY ALL)
SELECT p.host_tax_id, p.path_tax_id, p.pathogen_root_label, jl.host_threshold, jl.path_threshold AS pathogen_threshold, host_dataset_count AS num_host_datasets, ml.c AS num_pathogen_datasets, jl.c AS num_shared_datasets
FROM fx_meta p JOIN jl USING (host_tax_id, path_tax_id, pathogen_root_label) JOIN hc USING (host_tax_id, host_threshold) JOIN ml USING (path_tax_id, pathogen_root_label, path_threshold)""",
    "threshold_set_intersections": f"{_grid(THRESHOLDS)} SELECT host_tax_id, path_tax_id, host_threshold, path_threshold, both_dataset_count AS num_shared_datasets FROM jc",
    "threshold_sets": f"""{_grid(THRESHOLDS)}, num AS (SELECT acc, row_number() OVER (ORDER BY acc) - 1 AS k FROM (SELECT acc FROM fx_host UNION SELECT acc FROM fx_microbe)),
b AS (SELECT tax_id, acc, max(total_abundance) AS x FROM fx_host WHERE tax_id IN (FROM hids) GROUP BY ALL UNION ALL SELECT tax_id, acc, max(total_abundance) FROM fx_microbe WHERE tax_id IN (FROM mids) GROUP BY ALL)
SELECT tax_id, threshold, k // 32768 AS chunk, count(*) AS n, sha256(string_agg(k, ',' ORDER BY k)) AS members_sha256 FROM b JOIN t ON x >= threshold JOIN num USING (acc) GROUP BY ALL""",
    "pair_abundance": f"{_ABUND} SELECT * FROM pr",
    "pair_abundance_summary": f"{_ABUND} SELECT count(*) AS n_rows, count(DISTINCT host_tax_id) AS n_hosts, count(DISTINCT microbe_tax_id) AS n_microbes, count(DISTINCT SRA_accession) AS n_accessions, round(avg(host_abundance), 6) AS avg_host_abundance, round(avg(microbe_abundance), 6) AS avg_microbe_abundance FROM pr",
    "unique_accessions": f"{DUCKDB} SELECT DISTINCT unnest(SRA_datasets) AS acc FROM fx_pairs_lists",
    "accession_metadata": f"{DUCKDB}, {_PAIRS} SELECT {_SRA} FROM fx_sra_meta WHERE acc IN (SELECT acc FROM px)",
    "accession_metadata_with_pairs": f"{DUCKDB}, {_PAIRS} SELECT {_SRA}, host_tax_id, microbe_tax_id FROM fx_sra_meta JOIN px USING (acc)",
    "metadata_summary": f"{DUCKDB}, {_PAIRS} SELECT count(*) AS n_rows, count(DISTINCT acc) AS n_accessions, count(DISTINCT (host_tax_id, microbe_tax_id)) AS n_pairs FROM fx_sra_meta JOIN px USING (acc)",
    "coo_index_rows": f"{DUCKDB} SELECT acc, row_number() OVER (ORDER BY acc) - 1 AS row_idx FROM (SELECT DISTINCT acc FROM fx_abundance)",
    "coo_index_cols": f"{DUCKDB} SELECT tax_id, row_number() OVER (ORDER BY tax_id) - 1 AS col_idx FROM (SELECT DISTINCT tax_id FROM fx_abundance)",
    "coo_matrix": f"""{DUCKDB}, r AS (SELECT acc, row_number() OVER (ORDER BY acc) - 1 AS row_idx FROM (SELECT DISTINCT acc FROM fx_abundance)), c AS (SELECT tax_id, row_number() OVER (ORDER BY tax_id) - 1 AS col_idx FROM (SELECT DISTINCT tax_id FROM fx_abundance))
SELECT row_idx, col_idx, total_abundance AS value FROM fx_abundance JOIN r USING (acc) JOIN c USING (tax_id) WHERE total_abundance > 0""",
    "taxon_embeddings": _embedding("tax_id", "acc"),
    "dataset_embeddings": _embedding("acc", "tax_id"),
    "taxon_embedding_columns": f"WITH e AS ({_embedding('tax_id', 'acc')}) SELECT tax_id, " + ", ".join(f"max(CASE WHEN dim = {i} THEN value END) AS emb_{i}" for i in range(STUDY.dims)) + " FROM e GROUP BY tax_id",
    "dataset_vectors": f"WITH e AS ({_embedding('acc', 'tax_id', 'CAST(round({} * 1000000, 0) AS BIGINT)')}) SELECT acc, count(*) AS dims, string_agg(value, ',' ORDER BY dim) AS millionths FROM e GROUP BY acc",
    "sign_table": f"{DUCKDB} SELECT tax_id, CAST(d AS INTEGER) AS dim, {_SIGN.format(key='tax_id')} AS sign FROM (SELECT DISTINCT tax_id FROM fx_abundance) CROSS JOIN range({STUDY.dims}) r(d)",
    "taxa_ids": f"{DUCKDB} SELECT DISTINCT tax_id FROM fx_abundance",
    "coverage_report": f"""{DUCKDB}, """
    + ", ".join(f"m_{k} AS (SELECT DISTINCT {k} FROM fx_meta), d_{k} AS (SELECT DISTINCT tax_id AS {k} FROM {v})" for k, v in (("host_tax_id", "fx_host"), ("path_tax_id", "fx_microbe")))
    + " UNION ALL ".join(f" SELECT '{k}' AS key, (SELECT count(*) FROM m_{k}) AS in_meta, (SELECT count(*) FROM d_{k}) AS in_data, (SELECT count(*) FROM (FROM m_{k} EXCEPT FROM d_{k})) AS only_meta, (SELECT count(*) FROM (FROM d_{k} EXCEPT FROM m_{k})) AS only_data" for k in ("host_tax_id", "path_tax_id")),
    "duplicate_pairs": f"{DUCKDB} SELECT host_tax_id, path_tax_id, count(*) AS n FROM fx_meta GROUP BY ALL HAVING count(*) > 1",
    "duplicate_labels": f"{DUCKDB} SELECT host_tax_id, path_tax_id, Interaction_type, count(*) AS n FROM fx_meta GROUP BY ALL HAVING count(*) > 1",
    "resolve_labels": f"{_grid(THRESHOLDS)}, {_LABELS} SELECT * FROM lab",
    "label_counts": f"{_grid(THRESHOLDS)}, {_LABELS} SELECT Interaction_type, count(*) AS n FROM lgrid GROUP BY ALL",
    "sample_pairs": f"{_grid(THRESHOLDS)}, {_LABELS} SELECT * FROM samp",
    "hypergeom_score": f"""{_grid(THRESHOLDS)}, {_margins("n.n")},
p AS (SELECT k.h, k.m, s, CASE WHEN s <= lo THEN 1.0 WHEN s > hi THEN 0.0 ELSE q END AS p FROM k JOIN mg USING (h, m) LEFT JOIN (SELECT k.h, k.m, s, sum(q) AS q FROM k JOIN pm ON pm.h = k.h AND pm.m = k.m AND x >= s GROUP BY ALL) USING (h, m, s))
SELECT {_KEYS}, round(CASE WHEN p = 0 THEN {LEAST_P!r} ELSE p END, 6) AS hyp_geo_score, round(-log10(CASE WHEN p = 0 THEN {LEAST_P!r} ELSE least(p, 1.0) END), 4) + 0.0 AS neg_log_p
FROM grid JOIN p ON h = host_dataset_count AND m = pathogen_dataset_count AND s = both_dataset_count""",
    # ln P(0) as a sum of small logarithms, then ratios of neighbours: exact enough for three digits far out in the tail
    "hypergeom_log_score": f"""{_grid(THRESHOLDS)}, k AS (SELECT DISTINCT host_dataset_count AS h, pathogen_dataset_count AS m, both_dataset_count AS s FROM grid),
mg AS (SELECT h, m, max(s) AS s1 FROM k GROUP BY ALL), z AS (SELECT h, unnest(range(1, m1 + 1)) AS m FROM (SELECT h, max(m) AS m1 FROM k GROUP BY h)),
p0 AS (SELECT h, m, sum(ln(1 - CAST(h AS DOUBLE) / ({STUDY.n_total} - m + 1))) OVER (PARTITION BY h ORDER BY m) AS l0 FROM z),
r AS (SELECT h, m, x, ln(CAST(h - x + 1 AS DOUBLE) * (m - x + 1) / (CAST(x AS DOUBLE) * ({STUDY.n_total} - h - m + x))) AS l FROM (SELECT h, m, unnest(range(1, least(h, m, s1 + 60) + 1)) AS x FROM mg)),
lp AS (SELECT h, m, x, l0 + sum(l) OVER (PARTITION BY h, m ORDER BY x) AS l FROM r JOIN p0 USING (h, m)),
p AS (SELECT k.h, k.m, s, any_value(a.l) + ln(sum(exp(b.l - a.l))) AS l FROM k JOIN lp a ON a.h = k.h AND a.m = k.m AND a.x = s JOIN lp b ON b.h = k.h AND b.m = k.m AND b.x BETWEEN s AND s + 60 GROUP BY ALL)
SELECT {_KEYS}, round(-coalesce(l, 0.0) / ln(10.0), 3) + 0.0 AS neg_log_p FROM grid LEFT JOIN p ON h = host_dataset_count AND m = pathogen_dataset_count AND s = both_dataset_count""",
    "fisher_p_universe": f"""{_grid(THRESHOLDS)}, {_margins("n.n")},
p AS (SELECT k.h, k.m, s, least(1.0, sum(pm.q)) AS p FROM k JOIN pm o ON o.h = k.h AND o.m = k.m AND o.x = s JOIN pm ON pm.h = k.h AND pm.m = k.m AND pm.q <= o.q * (1 + 1e-7) GROUP BY ALL)
SELECT {_KEYS}, round(p, 6) AS fisher_p FROM grid LEFT JOIN p ON h = host_dataset_count AND m = pathogen_dataset_count AND s = both_dataset_count""",
    "log_odds": f"{_grid(THRESHOLDS)} SELECT {_KEYS}, host_dataset_count / n AS fh, pathogen_dataset_count / n AS fp, both_dataset_count / n AS fhp, round({_ODDS}, 9) + 0.0 AS log_odds FROM grid CROSS JOIN n",
    "log_odds_local": f"""{_grid(THRESHOLDS)}, l AS (SELECT *, CAST(nullif(host_dataset_count + pathogen_dataset_count, 0) AS DOUBLE) AS k FROM grid)
SELECT {_KEYS}, host_dataset_count / k AS fh_2, pathogen_dataset_count / k AS fp_2, both_dataset_count / k AS fhp_2,
 round(log2((both_dataset_count / k + 1 / k) / ((host_dataset_count / k) * (pathogen_dataset_count / k) + 1 / k)), 9) AS log_odds_2 FROM l""",
    "cooccurrence_metrics": f"""{_grid(THRESHOLDS)}, q AS (SELECT grid.*, n, CAST(both_dataset_count AS DOUBLE) AS a, greatest(host_dataset_count - both_dataset_count, 0.0) AS b, greatest(pathogen_dataset_count - both_dataset_count, 0.0) AS c FROM grid CROSS JOIN n),
r AS (SELECT *, n - (a + b + c) AS d FROM q),
s AS (SELECT *, a / n AS pa_, b / n AS pb_, c / n AS pc_, d / n AS pd_ FROM r)
SELECT {_KEYS}, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(c AS DOUBLE) AS c, CAST(d AS DOUBLE) AS d, CASE WHEN a + b + c > 0 THEN a / (a + b + c) END AS jaccard, CASE WHEN 2 * a + b + c > 0 THEN 2 * a / (2 * a + b + c) END AS sorensen_dice,
 CASE WHEN a + b > 0 AND a + c > 0 THEN a / sqrt((a + b) * (a + c)) END AS ochiai,
 CASE WHEN a + b > 0 AND a + c > 0 AND b + d > 0 AND c + d > 0 THEN (a * d - b * c) / sqrt((a + b) * (a + c) * (b + d) * (c + d)) END AS phi,
 CAST((host_dataset_count - a) * (pathogen_dataset_count - a) AS DOUBLE) AS c_score, pa_ AS p_a, pb_ AS p_b, pc_ AS p_c, pd_ AS p_d,
 pa_ + pb_ AS p_row1, pc_ + pd_ AS p_row2, pa_ + pc_ AS p_col1, pb_ + pd_ AS p_col2,
 round(CASE WHEN pa_ > 0 THEN pa_ * log2(pa_ / ((pa_ + pb_) * (pa_ + pc_))) ELSE 0 END + CASE WHEN pb_ > 0 THEN pb_ * log2(pb_ / ((pa_ + pb_) * (pb_ + pd_))) ELSE 0 END
     + CASE WHEN pc_ > 0 THEN pc_ * log2(pc_ / ((pc_ + pd_) * (pa_ + pc_))) ELSE 0 END + CASE WHEN pd_ > 0 THEN pd_ * log2(pd_ / ((pc_ + pd_) * (pb_ + pd_))) ELSE 0 END, 9) + 0.0 AS mutual_info FROM s""",
    "fisher_p": f"""{_grid(THRESHOLDS)}, k AS (SELECT DISTINCT host_dataset_count AS h, pathogen_dataset_count AS m, both_dataset_count AS a FROM grid),
u AS (SELECT h, m, a, h - a AS b, m - a AS c, (h - a) + (m - a) AS d FROM k),
w AS (SELECT *, a + b AS wh, c + d AS bl, a + c AS dr FROM u WHERE b >= 0 AND c >= 0),
v AS (SELECT *, {_pmf("a", "wh", "bl", "dr")} AS p0, list_transform(range(greatest(0, dr - bl), least(dr, wh) + 1), lambda x: {_pmf("x", "wh", "bl", "dr")}) AS ps FROM w)
SELECT {_KEYS}, round(least(1.0, list_sum(list_filter(ps, lambda q: q <= p0 * (1 + 1e-7)))), 6) AS fisher_p FROM grid LEFT JOIN v ON h = host_dataset_count AND m = pathogen_dataset_count AND a = both_dataset_count""",
    "roc_points": f"""{_grid(THRESHOLDS)}, {_LABELS}, {_classes(_ONE)},
v AS (SELECT DISTINCT comparison, host_threshold, path_threshold, s, sign, np, nn FROM x),
cut AS (SELECT *, (s + lead(s) OVER (PARTITION BY comparison, host_threshold, path_threshold ORDER BY s)) / 2 AS c FROM v UNION ALL SELECT DISTINCT comparison, host_threshold, path_threshold, CAST('-inf' AS DOUBLE), sign, np, nn, CAST(NULL AS DOUBLE) FROM v)
SELECT cut.comparison, round(cut.host_threshold, 9) AS host_threshold, round(cut.path_threshold, 9) AS path_threshold, c * cut.sign AS cutoff,
 (SELECT count(*) FROM x WHERE x.pos = 0 AND x.s <= cut.s AND x.comparison = cut.comparison AND x.host_threshold = cut.host_threshold AND x.path_threshold = cut.path_threshold) / nn AS specificity,
 (SELECT count(*) FROM x WHERE x.pos = 1 AND x.s > cut.s AND x.comparison = cut.comparison AND x.host_threshold = cut.host_threshold AND x.path_threshold = cut.path_threshold) / np AS sensitivity, auc
FROM cut JOIN auc USING (comparison, host_threshold, path_threshold)""",
    "auc_summary": f"{_auc(_ONE)} SELECT * FROM res",
    "auc_grid": f"{_auc(COMPARISONS)} SELECT * FROM res",
    "auc_grid_all_ties": f"{_auc(COMPARISONS, ties='rank')} SELECT * FROM res",
    "auc_grid_unsampled": f"{_auc(COMPARISONS, sampled=False)} SELECT * FROM res",
    "class_medians": f"""{_grid(THRESHOLDS)}, {_LABELS}, {_classes(COMPARISONS, sampled=False)}
SELECT comparison, round(host_threshold, 9) AS host_threshold, round(path_threshold, 9) AS path_threshold, median(CASE WHEN pos = 1 THEN s END) AS case_median, median(CASE WHEN pos = 0 THEN s END) AS control_median
FROM sc GROUP BY ALL HAVING sum(pos) > 0 AND sum(1 - pos) > 0""",
    "roc_label_text": f"{_auc(_ONE)} SELECT comparison, host_threshold, path_threshold, 'AUC = ' || coalesce(printf('%.2f', CAST(round(CAST(round(auc, 9) AS DECIMAL(18, 9)), 2) AS DOUBLE)), 'NA') || chr(10) || 'N = ' || n_total AS label FROM res",
    "score_histogram": f"""{_grid(THRESHOLDS)}, {_LABELS}, h AS (SELECT Interaction_type, round({_ODDS}, 9) AS x FROM lgrid JOIN samp USING (host_tax_id, path_tax_id, Interaction_type) CROSS JOIN n), e AS (SELECT min(x) AS lo, max(x) AS hi FROM h)
SELECT Interaction_type, CAST(CASE WHEN hi > lo THEN least(50, 1 + floor((x - lo) / (hi - lo) * 50)) ELSE 1 END AS INTEGER) AS bin, count(*) AS n FROM h CROSS JOIN e GROUP BY ALL""",
    "status": f"{DUCKDB} SELECT 'Loaded ' || count(*) || ' pairs' AS status FROM fx_meta",
    "io_roundtrip": f"{DUCKDB} SELECT acc, tax_id, total_abundance FROM fx_abundance",
}
ORACLES |= {"shared_by_bitmaps": ORACLES["threshold_set_intersections"], "listed_pairs_by_bitmaps": ORACLES["listed_pair_shared_counts"]}
ORACLES |= {"threshold_summary_incremental": ORACLES["threshold_summary"], "clustered_alpha_diversity": ORACLES["alpha_diversity"], "row_groups": ORACLES["io_roundtrip"]}
ORACLES["pair_abundance_interaction"] = f"{_ABUND} SELECT * FROM pr WHERE (host_tax_id + microbe_tax_id) % 3 = 0"
_CRC_BITS = "list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda z: CAST(0 AS BIGINT))), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
_CRC = f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(acc, ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, b: {_CRC_BITS}), 4294967295)"
ORACLES |= {
    "scan_with_file": f"{DUCKDB} SELECT acc, tax_id, total_abundance, CASE WHEN tax_id > 1000 THEN 'true' ELSE 'false' END AS folder FROM fx_abundance",
    "scan_by_name": f"{DUCKDB} SELECT * FROM fx_meta",
    "scan_shards": f"{DUCKDB}, s AS (SELECT acc, CAST({_CRC} % 4 AS INTEGER) AS shard FROM (SELECT DISTINCT acc FROM fx_abundance)) SELECT acc, tax_id, total_abundance, shard FROM fx_abundance JOIN s USING (acc)",
    "table_append": f"{DUCKDB} SELECT acc, tax_id, total_abundance FROM fx_abundance",
    "update_from": f"{DUCKDB}, f AS (SELECT acc, count(*) AS n_rows, CAST(max(tax_id) AS VARCHAR) AS c FROM fx_host GROUP BY acc) SELECT acc, platform, coalesce(c, center) AS center, strftime(releasedate, '%Y-%m-%d') AS releasedate, coalesce(n_rows, 0) AS n_rows FROM fx_sra_meta LEFT JOIN f USING (acc)",
    "named_view": f"{DUCKDB} SELECT host_tax_id, count(*) AS n, count(DISTINCT Interaction_type) AS n_types FROM fx_meta GROUP BY host_tax_id",
}
