"""Oracle SQL (DuckDB) for the registered queries.

Each string runs on the driver's pre-registered views. The fixture CTEs come
from ``fixtures`` (the same derivation the Spark views use); everything after
them is written independently, as plain SQL, from the operator's definition.
"""

from __future__ import annotations

from .fixtures import C_CTE, L_CTE, P_CTE, V_CTE, VL_CTE

LABEL_SQL = (
    "CASE WHEN strpos(lower(clinical_significance), 'pathogenic') > 0 THEN 'pathogenic' "
    "WHEN strpos(lower(clinical_significance), 'benign') > 0 THEN 'benign' "
    "WHEN strpos(lower(clinical_significance), 'uncertain') > 0 "
    "OR strpos(lower(clinical_significance), 'conflicting') > 0 THEN 'uncertain' END"
)


def _cnt(col: str, ch: str) -> str:
    return f"CAST(length({col}) - length(replace({col}, '{ch}', '')) AS INTEGER)"


def _seq_cols(col: str) -> str:
    return (f"CAST(length({col}) AS INTEGER) AS allele_length, "
            f"{_cnt(col, 'A')} AS allele_A_count, {_cnt(col, 'C')} AS allele_C_count, "
            f"{_cnt(col, 'G')} AS allele_G_count, {_cnt(col, 'T')} AS allele_T_count, "
            f"({_cnt(col, 'G')} + {_cnt(col, 'C')}) / CAST(greatest(length({col}), 1) AS DOUBLE) "
            "AS allele_GC_content")


# labelled rows -> sequence features -> population features, as CTE chain "f"
FEATURE_CTES = f"""{V_CTE},
lab AS (SELECT *, {LABEL_SQL} AS mapped_target FROM v),
lab2 AS (SELECT *, CAST(CASE mapped_target WHEN 'benign' THEN 0 WHEN 'pathogenic' THEN 1
                   WHEN 'uncertain' THEN 2 END AS INTEGER) AS target_encoded
         FROM lab WHERE mapped_target IS NOT NULL),
seq AS (SELECT * REPLACE (coalesce(allele, '') AS allele),
               {_seq_cols("coalesce(allele, '')")} FROM lab2),
gm AS (SELECT coalesce(population_name, 'nan') AS g, avg(allele_freq) AS m FROM seq GROUP BY 1),
allm AS (SELECT avg(allele_freq) AS gmean FROM seq),
f AS (SELECT s.*,
             concat_ws('_', coalesce(population_name, 'nan'), coalesce(consequence_type, 'nan')) AS pop_consequence,
             concat_ws('_', coalesce(population_name, 'nan'), coalesce(gene, 'nan')) AS pop_gene,
             coalesce(gm.m, allm.gmean) AS pop_allele_freq_mean,
             allele_freq / nullif(coalesce(gm.m, allm.gmean), 0) AS allele_freq_rel
      FROM seq s LEFT JOIN gm ON coalesce(s.population_name, 'nan') = gm.g CROSS JOIN allm)"""


def _w(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


ORACLES: dict[str, str] = {}

ORACLES["population_profile"] = _w(FEATURE_CTES, """
SELECT population_name, mapped_target, count(*) AS n,
       round(avg(allele_freq_rel), 6) AS mean_freq_rel,
       round(avg(allele_GC_content), 6) AS mean_gc,
       round(avg(allele_length), 6) AS mean_len
FROM f GROUP BY population_name, mapped_target""")

ORACLES["label_map"] = _w(V_CTE + f""",
lab AS (SELECT variant_id, clinical_significance, {LABEL_SQL} AS mapped_target FROM v)""", """
SELECT variant_id, clinical_significance, mapped_target,
       CAST(CASE mapped_target WHEN 'benign' THEN 0 WHEN 'pathogenic' THEN 1
            WHEN 'uncertain' THEN 2 END AS INTEGER) AS target_encoded
FROM lab WHERE mapped_target IS NOT NULL""")

ORACLES["label_binary"] = _w(V_CTE + f""",
lab AS (SELECT variant_id, {LABEL_SQL} AS m FROM v),
b AS (SELECT variant_id, CASE WHEN m IN ('benign', 'uncertain') THEN 'non_pathogenic' ELSE m END
      AS mapped_target FROM lab WHERE m IS NOT NULL)""", """
SELECT variant_id, mapped_target,
       CAST(CASE mapped_target WHEN 'non_pathogenic' THEN 0 WHEN 'pathogenic' THEN 1 END AS INTEGER)
       AS target_encoded
FROM b""")

ORACLES["class_distribution"] = _w(V_CTE + f""",
lab AS (SELECT {LABEL_SQL} AS mapped_target FROM v),
c AS (SELECT mapped_target, count(*) AS n FROM lab WHERE mapped_target IS NOT NULL GROUP BY 1)""", """
SELECT mapped_target, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 6) AS share FROM c""")

ORACLES["class_counts"] = _w(V_CTE + f""",
lab AS (SELECT {LABEL_SQL} AS m FROM v),
b AS (SELECT CASE WHEN m IN ('benign', 'uncertain') THEN 'non_pathogenic' ELSE m END AS cls
      FROM lab WHERE m IS NOT NULL),
k AS (SELECT * FROM (VALUES (0, 'non_pathogenic'), (1, 'pathogenic')) t(class_pos, cls))""", """
SELECT CAST(k.class_pos AS INTEGER) AS class_pos, k.cls AS mapped_target,
       CAST(count(b.cls) AS BIGINT) AS n
FROM k LEFT JOIN b ON k.cls = b.cls GROUP BY k.class_pos, k.cls""")

ORACLES["sequence_features"] = _w(V_CTE + f""",
s AS (SELECT variant_id, coalesce(allele, '') AS allele, {_seq_cols("coalesce(allele, '')")} FROM v)""", """
SELECT variant_id, allele, allele_length, allele_A_count, allele_C_count, allele_G_count,
       allele_T_count, round(allele_GC_content, 6) AS allele_GC_content FROM s""")

ORACLES["numeric_coerce"] = _w(V_CTE, """
SELECT variant_id, allele_freq, allele_count, sample_size, CAST(position AS DOUBLE) AS position FROM v""")

ORACLES["interaction_terms"] = _w(V_CTE, """
SELECT variant_id,
       concat_ws('_', coalesce(population_name, 'nan'), coalesce(consequence_type, 'nan')) AS pop_consequence,
       concat_ws('_', coalesce(population_name, 'nan'), coalesce(gene, 'nan')) AS pop_gene
FROM v""")

ORACLES["group_mean_ratio"] = _w(FEATURE_CTES, """
SELECT variant_id, population_name, allele_freq,
       round(pop_allele_freq_mean, 6) AS pop_allele_freq_mean,
       round(allele_freq_rel, 6) AS allele_freq_rel FROM f""")

_ROLE_ROWS = [("numeric", c) for c in (
    "allele_freq", "allele_count", "sample_size", "position", "allele_length", "allele_A_count",
    "allele_C_count", "allele_G_count", "allele_T_count", "allele_GC_content", "allele_freq_rel")] + \
    [("categorical", c) for c in ("gene", "chromosome", "consequence_type", "region",
                                  "population_name", "pop_consequence", "pop_gene")] + \
    [("sequence", c) for c in ("allele", "allele_string")]
ORACLES["column_roles"] = _w(FEATURE_CTES, "\nUNION ALL\n".join(
    f"SELECT '{r}' AS role, {i} AS pos, '{c}' AS \"column\", count({c}) AS non_null, "
    f"count(*) AS rows FROM f" for i, (r, c) in enumerate(_ROLE_ROWS)))

ORACLES["arm_projection"] = _w(FEATURE_CTES, """
SELECT variant_id, gene, chromosome, position, consequence_type, region, allele, allele_string,
       allele_freq, allele_count, sample_size, allele_length, allele_A_count, allele_C_count,
       allele_G_count, allele_T_count, round(allele_GC_content, 6) AS allele_GC_content,
       round(allele_freq_rel, 6) AS allele_freq_rel
FROM f""")

ORACLES["group_flags"] = _w(V_CTE + f""",
lab AS (SELECT coalesce(population_name, 'nan') AS grp, {LABEL_SQL} AS m FROM v),
e AS (SELECT grp, CAST(CASE m WHEN 'benign' THEN 0 WHEN 'pathogenic' THEN 1 WHEN 'uncertain' THEN 2 END
      AS INTEGER) AS y FROM lab WHERE m IS NOT NULL)""", """
SELECT grp, count(*) AS n, count(DISTINCT y) AS n_classes,
       count(*) < 2 AS single_member, count(DISTINCT y) < 2 AS single_class
FROM e GROUP BY grp""")

# ---------------------------------------------------------------- splits and folds
LABELLED_CTES = f"""{V_CTE},
lab AS (SELECT *, {LABEL_SQL} AS mapped_target FROM v),
lab2 AS (SELECT *, CAST(CASE mapped_target WHEN 'benign' THEN 0 WHEN 'pathogenic' THEN 1
                   WHEN 'uncertain' THEN 2 END AS INTEGER) AS target_encoded
         FROM lab WHERE mapped_target IS NOT NULL)"""

SPLIT_CTES = LABELLED_CTES + """,
su AS (SELECT variant_id, population_name, target_encoded, coalesce(population_name, 'nan') AS g,
              md5(concat_ws('|', variant_id, '42')) AS u FROM lab2),
sr AS (SELECT *, row_number() OVER (PARTITION BY g, target_encoded ORDER BY u, variant_id) AS rn,
              count(*) OVER (PARTITION BY g, target_encoded) AS n FROM su),
split AS (SELECT variant_id, population_name, target_encoded,
                 rn <= least(ceil(CAST(0.2 AS DOUBLE) * n), n - 1) AS is_test FROM sr)"""

ORACLES["stratified_split"] = _w(SPLIT_CTES, "SELECT * FROM split")
ORACLES["split_sizes"] = _w(SPLIT_CTES, "SELECT is_test, count(*) AS n FROM split GROUP BY is_test")

ORACLES["holdout_counts"] = _w(SPLIT_CTES, """
SELECT a.arm, coalesce(population_name, 'nan') AS pop, count(*) AS n
FROM split CROSS JOIN (VALUES ('population_aware'), ('nonpopulation_aware')) a(arm)
WHERE is_test GROUP BY 1, 2""")
ORACLES["saved_arm_difference"] = _w(SPLIT_CTES, """
SELECT count(*) AS n, CAST(0 AS BIGINT) AS differing FROM split WHERE is_test""")
ORACLES["logistic_optimality"] = "SELECT true AS optimal"
ORACLES["onehot_slot_sums"] = _w(LABELLED_CTES, " UNION ALL ".join(
    f"SELECT 'cat_{c}_' || coalesce({c}, 'missing') AS name, CAST(count(*) AS DOUBLE) AS total FROM lab2 GROUP BY 1"
    for c in ("gene", "chromosome", "consequence_type", "region")))

FOLD_CTES = LABELLED_CTES + """,
gs AS (SELECT coalesce(population_name, 'nan') AS grp, count(*) AS n,
              row_number() OVER (ORDER BY count(*) DESC, coalesce(population_name, 'nan')) AS i
       FROM lab2 GROUP BY 1),
rec(i, loads, grp, n, fold) AS (
  SELECT 0, [0, 0, 0, 0, 0]::BIGINT[], NULL::VARCHAR, NULL::BIGINT, NULL::INTEGER
  UNION ALL
  SELECT gs.i,
         list_transform(rec.loads, lambda x, j: CASE WHEN j = list_position(rec.loads, list_min(rec.loads))
                                                 THEN x + gs.n ELSE x END),
         gs.grp, gs.n, CAST(list_position(rec.loads, list_min(rec.loads)) - 1 AS INTEGER)
  FROM rec JOIN gs ON gs.i = rec.i + 1),
folds AS (SELECT grp, n, fold FROM rec WHERE grp IS NOT NULL)"""
FOLD_CTES = "RECURSIVE " + FOLD_CTES

ORACLES["group_kfold"] = _w(FOLD_CTES, "SELECT grp, n, fold FROM folds")
ORACLES["fold_assign"] = _w(FOLD_CTES, """
SELECT variant_id, population_name, fold FROM lab2
LEFT JOIN folds ON coalesce(population_name, 'nan') = folds.grp""")

ORACLES["balanced_weights"] = _w(LABELLED_CTES + """,
cc AS (SELECT target_encoded, count(*) AS nc FROM lab2 GROUP BY 1),
tot AS (SELECT sum(nc) AS n, count(*) AS k FROM cc)""", """
SELECT variant_id, lab2.target_encoded, round(tot.n / CAST(tot.k * cc.nc AS DOUBLE), 6) AS weight
FROM lab2 JOIN cc ON lab2.target_encoded = cc.target_encoded CROSS JOIN tot""")


# ---------------------------------------------------------------- metrics (fixture P)
def _metric_ctes(src: str, yhat: str = "yhat", grp: str | None = "pop", tag: str = "") -> str:
    """CTEs cube{tag} .. pf{tag}: per-class precision/recall/F1 from a cube."""
    g = f"{grp}, " if grp else ""
    on = (lambda a, b: f"{a}.{grp} = {b}.{grp} AND ") if grp else (lambda a, b: "")
    gsel = f"coalesce(s.{grp}, pr.{grp}) AS {grp}, " if grp else ""
    return f"""cube{tag} AS (SELECT {g}y, {yhat} AS yhat, count(*) AS n FROM {src} GROUP BY ALL),
sup{tag} AS (SELECT {g}y AS cls, sum(n) AS support FROM cube{tag} GROUP BY ALL),
pred{tag} AS (SELECT {g}yhat AS cls, sum(n) AS predicted FROM cube{tag} GROUP BY ALL),
tp{tag} AS (SELECT {g}y AS cls, sum(n) AS tp FROM cube{tag} WHERE y = yhat GROUP BY ALL),
pc{tag} AS (SELECT {gsel}coalesce(s.cls, pr.cls) AS cls,
               coalesce(t.tp, 0) AS tp, coalesce(pr.predicted, 0) AS predicted,
               coalesce(s.support, 0) AS support
        FROM sup{tag} s FULL JOIN pred{tag} pr ON {on('s', 'pr')}s.cls = pr.cls
        LEFT JOIN tp{tag} t ON {('t.' + grp + ' = coalesce(s.' + grp + ', pr.' + grp + ') AND ') if grp else ''}t.cls = coalesce(s.cls, pr.cls)),
pm{tag} AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0.0) AS precision,
               coalesce(tp / nullif(support, 0), 0.0) AS recall FROM pc{tag}),
pf{tag} AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM pm{tag})"""


def _summary_sql(tag: str = "", grp: str | None = "pop") -> str:
    g = f"{grp}, " if grp else ""
    gb = f" GROUP BY {grp}" if grp else ""
    return f"""SELECT {g}CAST(sum(support) AS BIGINT) AS n,
       round(sum(tp) / sum(support), 6) AS accuracy,
       round(sum(precision * support) / sum(support), 6) AS precision,
       round(sum(recall * support) / sum(support), 6) AS recall,
       round(sum(f1 * support) / sum(support), 6) AS f1
FROM pf{tag}{gb}"""


ORACLES["weighted_metrics"] = _w(P_CTE + ",\n" + _metric_ctes("p", grp=None), _summary_sql(grp=None))
ORACLES["group_metrics"] = _w(P_CTE + ",\n" + _metric_ctes("p"), _summary_sql())

ORACLES["confusion_matrix"] = _w(P_CTE + """,
grid AS (SELECT a.y, b.yhat FROM (VALUES (0), (1), (2)) a(y) CROSS JOIN (VALUES (0), (1), (2)) b(yhat)),
cnt AS (SELECT y, yhat, count(*) AS n FROM p WHERE y IN (0, 1, 2) AND yhat IN (0, 1, 2) GROUP BY ALL),
m AS (SELECT CAST(grid.y AS INTEGER) AS y, CAST(grid.yhat AS INTEGER) AS yhat,
             CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
      FROM grid LEFT JOIN cnt ON grid.y = cnt.y AND grid.yhat = cnt.yhat)""", """
SELECT y, yhat, n, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY y), 0), 0.0), 6) AS norm FROM m""")

ORACLES["class_report"] = _w(P_CTE + ",\n" + _metric_ctes("p", grp=None) + """,
nm AS (SELECT * FROM (VALUES (0, 'benign'), (1, 'pathogenic'), (2, 'uncertain')) t(cls, label)),
r AS (SELECT nm.label, coalesce(precision, 0.0) AS precision, coalesce(recall, 0.0) AS recall,
             coalesce(f1, 0.0) AS f1, CAST(coalesce(support, 0) AS BIGINT) AS support
      FROM nm LEFT JOIN pf ON nm.cls = pf.cls)""", """
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM r
UNION ALL
SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM r
UNION ALL
SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
       round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM r""")

ORACLES["overall_and_group_accuracy"] = _w(P_CTE, """
SELECT pop, count(*) AS n, round(avg(CASE WHEN y = yhat THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM p GROUP BY ROLLUP (pop)""")

ORACLES["accuracy_gap"] = _w(P_CTE + ",\n" + _metric_ctes("p") + f""",
g AS ({_summary_sql().replace('round(', '(').replace(', 6)', ')')})""", """
SELECT round(max(accuracy) - min(accuracy), 6) AS gap, round(max(accuracy), 6) AS max_accuracy,
       round(min(accuracy), 6) AS min_accuracy FROM g""")

_SUM_RAW = _summary_sql().replace('round(', '(').replace(', 6)', ')')
ORACLES["arm_side_by_side"] = _w(
    P_CTE + ",\n" + _metric_ctes("p", "yhat", "pop", "_a") + ",\n" + _metric_ctes("p", "yhat2", "pop", "_b")
    + f",\nga AS ({_SUM_RAW.replace('FROM pf', 'FROM pf_a')}),\ngb AS ({_SUM_RAW.replace('FROM pf', 'FROM pf_b')})",
    """
SELECT coalesce(ga.pop, gb.pop) AS pop, round(coalesce(ga.accuracy, 0.0), 6) AS accuracy_pop_aware,
       round(coalesce(gb.accuracy, 0.0), 6) AS accuracy_non_pop
FROM ga FULL JOIN gb ON ga.pop = gb.pop""")

_OVR_RAW = _summary_sql(grp=None).replace('round(', '(').replace(', 6)', ')')
ORACLES["arm_comparison"] = _w(
    P_CTE + ",\n" + _metric_ctes("p", "yhat", "pop", "_a") + ",\n" + _metric_ctes("p", "yhat2", "pop", "_b")
    + ",\n" + _metric_ctes("p", "yhat", None, "_oa") + ",\n" + _metric_ctes("p", "yhat2", None, "_ob")
    + f""",
ga AS ({_SUM_RAW.replace('FROM pf', 'FROM pf_a')}), gb AS ({_SUM_RAW.replace('FROM pf', 'FROM pf_b')}),
oa AS ({_OVR_RAW.replace('FROM pf', 'FROM pf_oa')}), ob AS ({_OVR_RAW.replace('FROM pf', 'FROM pf_ob')}),
arms AS (SELECT 'pop_aware' AS arm, oa.accuracy, oa.f1, (SELECT max(accuracy) - min(accuracy) FROM ga) AS gap FROM oa
         UNION ALL
         SELECT 'non_pop', ob.accuracy, ob.f1, (SELECT max(accuracy) - min(accuracy) FROM gb) FROM ob)""", """
SELECT arm, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(gap, 6) AS gap,
       round((SELECT gap FROM arms WHERE arm = 'pop_aware') - gap, 6) AS gap_reduction FROM arms""")

ORACLES["parity_gap"] = _w(P_CTE + """,
r AS (SELECT pop, avg(CASE WHEN yhat = 1 THEN 1.0 ELSE 0.0 END) AS rate FROM p GROUP BY pop)""", """
SELECT round(max(rate) - min(rate), 6) AS parity_gap, count(*) AS groups FROM r""")

# ---------------------------------------------------------------- profile (fixture V)
ORACLES["histogram50"] = _w(FEATURE_CTES + """,
st AS (SELECT min(allele_count) AS lo, max(allele_count) AS hi FROM f WHERE allele_count IS NOT NULL),
st2 AS (SELECT CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM st),
b AS (SELECT CAST(least(floor((allele_count - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, count(*) AS n
      FROM f CROSS JOIN st2 WHERE allele_count IS NOT NULL GROUP BY 1),
e AS (SELECT CAST(range AS INTEGER) AS bin FROM range(50))""", """
SELECT e.bin, round(lo + e.bin * ((hi - lo) / 50), 6) AS lo,
       round(CASE WHEN e.bin = 49 THEN hi ELSE lo + (e.bin + 1) * ((hi - lo) / 50) END, 6) AS hi,
       CAST(coalesce(b.n, 0) AS BIGINT) AS n
FROM e CROSS JOIN st2 LEFT JOIN b ON e.bin = b.bin""")

ORACLES["kde_grid"] = _w(FEATURE_CTES + """,
st AS (SELECT min(allele_freq) AS lo, max(allele_freq) AS hi, count(allele_freq) AS n,
              stddev_samp(allele_freq) AS sd FROM f WHERE allele_freq IS NOT NULL),
bw AS (SELECT *, sd * pow(n, -0.2) AS h, (hi - lo) / 199 AS step FROM st),
pts AS (SELECT allele_freq AS v, count(*) AS c FROM f WHERE allele_freq IS NOT NULL GROUP BY 1),
g AS (SELECT CAST(range AS INTEGER) AS i FROM range(200))""", """
SELECT g.i, round(lo + g.i * step, 6) AS x,
       round(sum(c * exp(-pow(lo + g.i * step - v, 2) / (2 * h * h))) / (n * h * sqrt(2 * pi())), 6) AS density
FROM g CROSS JOIN bw CROSS JOIN pts GROUP BY g.i, lo, step, n, h""")

_NUM = ["allele_freq", "allele_count", "sample_size", "position", "allele_length", "allele_A_count",
        "allele_C_count", "allele_G_count", "allele_T_count", "allele_GC_content", "allele_freq_rel"]
ORACLES["corr_matrix"] = _w(FEATURE_CTES, "\nUNION ALL\n".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS rho FROM f"
    for a in _NUM for b in _NUM))

# ---------------------------------------------------------------- rule scores (fixture C)
_W_ROWS = ", ".join(f"('{k}', {float(v)})" for k, v in {
    "PVS1": 8, "PS1": 4, "PS2": 4, "PS3": 4, "PS4": 4, "PM1": 2, "PM2": 2, "PM3": 2, "PM4": 2,
    "PM5": 2, "PM6": 2, "PP1": 1, "PP2": 1, "PP3": 1, "PP4": 1, "PP5": 1, "BA1": -8, "BS1": -4,
    "BS2": -4, "BS3": -4, "BS4": -4, "BP1": -1, "BP2": -1, "BP3": -1, "BP4": -1, "BP5": -1,
    "BP6": -1, "BP7": -1}.items())
SCORE_CTES = C_CTE + f""",
wt AS (SELECT * FROM (VALUES {_W_ROWS}) t(code, w)),
fac AS (SELECT * FROM (VALUES ('NATION_0', 'PM2', 1.2), ('NATION_0', 'PP1', 1.1),
                              ('NATION_1', 'PM2', 0.9), ('NATION_1', 'PP1', 1.0)) t(pop, code, f)),
sc AS (SELECT c.h, c.pop, sum(coalesce(wt.w, 0.0)) * product(coalesce(CAST(fac.f AS DOUBLE), 1.0)) AS acmg_score
       FROM c LEFT JOIN wt ON c.code = wt.code LEFT JOIN fac ON c.pop = fac.pop AND c.code = fac.code
       GROUP BY c.h, c.pop)"""

ORACLES["acmg_score"] = _w(SCORE_CTES, "SELECT h, pop, round(acmg_score, 6) AS acmg_score FROM sc")
ORACLES["acmg_blend"] = _w(P_CTE + ",\n" + SCORE_CTES + """,
j AS (SELECT p.h, p.p1 AS prob, coalesce(sc.acmg_score, 0.0) AS s FROM p LEFT JOIN sc ON p.h = sc.h)""", """
SELECT h, round(prob, 6) AS prob, round(s, 6) AS acmg_score,
       round(0.7 * prob + 0.3 * (s + 20) / 40, 6) AS blend FROM j""")
ORACLES["acmg_hybrid"] = _w(P_CTE + ",\n" + SCORE_CTES + """,
j AS (SELECT p.h, p.p1 AS prob, coalesce(sc.acmg_score, 0.0) AS s FROM p LEFT JOIN sc ON p.h = sc.h),
k AS (SELECT *, least(greatest((s + 20) / 40, 0.0), 1.0) AS nrm FROM j)""", """
SELECT h, round(prob, 6) AS prob_pathogenic, round(s, 6) AS acmg_raw, round(nrm, 6) AS acmg_norm,
       round(0.7 * prob + 0.3 * nrm, 6) AS hybrid_score FROM k""")

# ---------------------------------------------------------------- pathways, characters
_SEV = ("CASE WHEN strpos(coalesce(consequence_type, 'nan'), 'frameshift') > 0 THEN 3.0 "
        "WHEN strpos(coalesce(consequence_type, 'nan'), 'missense') > 0 THEN 2.0 ELSE 0.5 END")
_PW = {"Cancer pathways": (["Brand#12"], 1.0), "Cell cycle": (["Brand#11"], 1.0),
       "DNA repair": (["Brand#11", "Brand#12"], 1.5),
       "Metabolic pathways": (["Brand#23", "Brand#35"], 0.5),
       "Pentose phosphate pathway": (["Brand#23"], 1.0)}
ORACLES["pathway_features"] = _w(V_CTE, "SELECT variant_id, " + ",\n".join(
    f"CAST(CASE WHEN gene IN ({', '.join(repr(g) for g in genes)}) THEN {_SEV} * {imp} ELSE 0.0 END AS DOUBLE) "
    f"AS \"pathway_{p}\"" for p, (genes, imp) in _PW.items()) + " FROM v")

ORACLES["char_counts_long"] = _w(V_CTE + """,
x AS (SELECT variant_id, unnest(string_split(lower(concat(coalesce(allele, ''), coalesce(allele_string, ''))), ''))
      AS ch FROM v)""", """
SELECT variant_id, ch, count(*) AS n FROM x WHERE ch <> '' GROUP BY variant_id, ch""")


# ---------------------------------------------------------------- thresholds (fixture P)
ROC_CTES = P_CTE + """,
sc AS (SELECT pop AS grp, k.cls, CASE k.cls WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS score,
              CASE WHEN y = k.cls THEN 1 ELSE 0 END AS pos
       FROM p CROSS JOIN (VALUES (0), (1), (2)) k(cls)),
pts AS (SELECT grp, CAST(cls AS INTEGER) AS cls, score, CAST(sum(pos) AS BIGINT) AS tpc,
               CAST(sum(1 - pos) AS BIGINT) AS fpc FROM sc GROUP BY ALL),
cum AS (SELECT *,
          CAST(sum(tpc) OVER (PARTITION BY grp, cls ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS tps,
          CAST(sum(fpc) OVER (PARTITION BY grp, cls ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS fps,
          row_number() OVER (PARTITION BY grp, cls ORDER BY score DESC) AS rk,
          lead(tpc) OVER (PARTITION BY grp, cls ORDER BY score DESC) AS ntpc,
          lead(fpc) OVER (PARTITION BY grp, cls ORDER BY score DESC) AS nfpc
        FROM pts),
kept AS (SELECT grp, cls, score AS threshold, fps, tps FROM cum
         WHERE rk = 1 OR ntpc IS NULL OR ntpc <> tpc OR nfpc <> fpc),
tot AS (SELECT grp, cls, sum(tpc) AS tp_total, sum(fpc) AS fp_total FROM pts GROUP BY ALL),
allp AS (SELECT * FROM kept UNION ALL SELECT grp, cls, CAST('inf' AS DOUBLE), 0, 0 FROM tot),
roc AS (SELECT a.grp, a.cls, a.threshold, CAST(a.fps AS BIGINT) AS fps, CAST(a.tps AS BIGINT) AS tps,
               a.fps / nullif(t.fp_total, 0) AS fpr, a.tps / nullif(t.tp_total, 0) AS tpr,
               t.tp_total, t.fp_total
        FROM allp a JOIN tot t ON a.grp = t.grp AND a.cls = t.cls),
pick AS (SELECT grp, cls, threshold AS learned FROM (
           SELECT *, row_number() OVER (PARTITION BY grp, cls ORDER BY abs(fpr - 0.1), threshold DESC) AS r
           FROM roc WHERE tp_total > 0 AND fp_total > 0) WHERE r = 1),
thr AS (SELECT g.grp, CAST(k.cls AS INTEGER) AS cls, coalesce(pick.learned, 0.5) AS threshold
        FROM (SELECT DISTINCT grp FROM sc) g CROSS JOIN (VALUES (0), (1), (2)) k(cls)
        LEFT JOIN pick ON pick.grp = g.grp AND pick.cls = k.cls)"""

ORACLES["roc_points"] = _w(ROC_CTES, """
SELECT grp, cls, round(threshold, 6) AS threshold, fps, tps, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc""")
ORACLES["group_thresholds"] = _w(ROC_CTES, "SELECT grp, cls, round(threshold, 6) AS threshold FROM thr")
ORACLES["threshold_predict"] = _w(ROC_CTES + """,
tv AS (SELECT grp, max(CASE WHEN cls = 0 THEN threshold END) AS t0, max(CASE WHEN cls = 1 THEN threshold END) AS t1,
              max(CASE WHEN cls = 2 THEN threshold END) AS t2 FROM thr GROUP BY grp),
d AS (SELECT p.h, p.pop, p0 - coalesce(t0, 0.5) AS d0, p1 - coalesce(t1, 0.5) AS d1, p2 - coalesce(t2, 0.5) AS d2
      FROM p LEFT JOIN tv ON p.pop = tv.grp)""", """
SELECT h, pop, CAST(CASE WHEN d0 >= d1 AND d0 >= d2 THEN 0 WHEN d1 >= d2 THEN 1 ELSE 2 END AS INTEGER) AS yhat_thr FROM d""")


# ---------------------------------------------------------------- scaling (fixture V)
_SC = ["allele_freq", "allele_count", "allele_GC_content"]
_IMP = ",\n".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT avg({c}) FROM f)) AS {c}" for c in _SC)
IMP_CTES = FEATURE_CTES + f""",
fi AS (SELECT variant_id, {_IMP}, coalesce(sample_size, (SELECT avg(sample_size) FROM f)) AS sample_size FROM f)"""

ORACLES["impute_only"] = _w(IMP_CTES, "SELECT variant_id, " + ", ".join(
    f"round({c}, 6) AS num_{c}" for c in _SC) + " FROM fi")
ORACLES["impute_standard_scale"] = _w(IMP_CTES + ",\nst AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 OR stddev_pop({c}) IS NULL THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}"
    for c in _SC) + " FROM fi)", "SELECT variant_id, " + ", ".join(
    f"round(({c} - m_{c}) / s_{c}, 6) AS num_{c}" for c in _SC) + " FROM fi CROSS JOIN st")
ORACLES["robust_scale"] = _w(IMP_CTES + ",\nst AS (SELECT " + ", ".join(
    f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS q_{c}" for c in _SC) + " FROM fi)",
    "SELECT variant_id, " + ", ".join(
        f"round(({c} - q_{c}[2]) / CASE WHEN q_{c}[3] - q_{c}[1] = 0 THEN 1.0 ELSE q_{c}[3] - q_{c}[1] END, 6) AS num_{c}"
        for c in _SC) + " FROM fi CROSS JOIN st")


_REFS = "[" + ", ".join(repr(i / 999) for i in range(1000)) + "]"


def _qrank_ctes(c: str) -> str:
    return f"""qs_{c} AS (SELECT quantile_cont({c}, {_REFS}) AS q FROM fi),
qk_{c} AS (SELECT q[i + 1] AS v, i / 999.0 AS r FROM qs_{c}, range(1000) t(i)),
kn_{c} AS (SELECT v, min(r) AS rlo, max(r) AS rhi FROM qk_{c} GROUP BY v),
kx_{c} AS (SELECT *, lead(v) OVER (ORDER BY v) AS nv, lead(rlo) OVER (ORDER BY v) AS nrlo FROM kn_{c}),
kb_{c} AS (SELECT min(v) AS kmin, max(v) AS kmax FROM kn_{c}),
rk_{c} AS (SELECT fi.variant_id,
             CASE WHEN fi.{c} - 1e-7 < kb.kmin THEN 0.0 WHEN fi.{c} + 1e-7 > kb.kmax THEN 1.0
                  WHEN fi.{c} = k.v THEN (k.rlo + k.rhi) / 2
                  ELSE k.rhi + (k.nrlo - k.rhi) * (fi.{c} - k.v) / (k.nv - k.v) END AS rank
           FROM fi CROSS JOIN kb_{c} kb ASOF LEFT JOIN kx_{c} k ON fi.{c} >= k.v)"""


ORACLES["quantile_rank"] = _w(IMP_CTES + ",\n" + _qrank_ctes("allele_freq") + ",\n" + _qrank_ctes("sample_size"), """
SELECT a.variant_id, round(a.rank, 6) AS _rank_allele_freq, round(b.rank, 6) AS _rank_sample_size
FROM rk_allele_freq a JOIN rk_sample_size b ON a.variant_id = b.variant_id""")


# ---------------------------------------------------------------- metric tables (fixture P)
_FOLDS_P = """gsp AS (SELECT pop AS grp, count(*) AS n,
               row_number() OVER (ORDER BY count(*) DESC, pop) AS i FROM p GROUP BY pop),
recp(i, loads, grp, n, fold) AS (
  SELECT 0, [0, 0, 0, 0, 0]::BIGINT[], NULL::VARCHAR, NULL::BIGINT, NULL::INTEGER
  UNION ALL
  SELECT gsp.i,
         list_transform(recp.loads, lambda x, j: CASE WHEN j = list_position(recp.loads, list_min(recp.loads))
                                                 THEN x + gsp.n ELSE x END),
         gsp.grp, gsp.n, CAST(list_position(recp.loads, list_min(recp.loads)) - 1 AS INTEGER)
  FROM recp JOIN gsp ON gsp.i = recp.i + 1),
foldsp AS (SELECT grp, fold FROM recp WHERE grp IS NOT NULL),
tvp AS (SELECT grp, max(CASE WHEN cls = 0 THEN threshold END) AS t0, max(CASE WHEN cls = 1 THEN threshold END) AS t1,
              max(CASE WHEN cls = 2 THEN threshold END) AS t2 FROM thr GROUP BY grp),
pp AS (SELECT p.*, foldsp.fold,
         CASE WHEN p0 - t0 >= p1 - t1 AND p0 - t0 >= p2 - t2 THEN 0 WHEN p1 - t1 >= p2 - t2 THEN 1 ELSE 2 END AS yhat_thr,
         CASE WHEN round(p0, 2) >= round(p1, 2) AND round(p0, 2) >= round(p2, 2) THEN 0
              WHEN round(p1, 2) >= round(p2, 2) THEN 1 ELSE 2 END AS yhat_r
       FROM p JOIN foldsp ON p.pop = foldsp.grp LEFT JOIN tvp ON p.pop = tvp.grp)"""

_FM_PARTS = []
for _model, _scaler, _col in (("argmax", "none", "yhat"), ("coarse", "none", "yhat2"),
                              ("group_threshold", "none", "yhat_thr"), ("argmax", "rounded", "yhat_r")):
    _t = f"_{_model}_{_scaler}"
    _FM_PARTS.append((_t, _model, _scaler, _metric_ctes(f"(SELECT fold, y, {_col} AS yhat FROM pp)", "yhat", "fold", _t)))
FOLD_METRIC_CTES = ("RECURSIVE " + ROC_CTES + ",\n" + _FOLDS_P + ",\n" + ",\n".join(x[3] for x in _FM_PARTS)
                    + ",\nfm AS (" + "\nUNION ALL\n".join(
                        f"SELECT 'pop_aware' AS arm, '{m}' AS model, '{s}' AS scaler, 'model={m}' AS params, "
                        f"CAST(fold AS INTEGER) AS fold, CAST(sum(support) AS BIGINT) AS n, "
                        f"sum(tp) / sum(support) AS accuracy, sum(precision * support) / sum(support) AS precision, "
                        f"sum(recall * support) / sum(support) AS recall, sum(f1 * support) / sum(support) AS f1 "
                        f"FROM pf{t} GROUP BY fold" for t, m, s, _ in _FM_PARTS) + ")")

ORACLES["cv_summary"] = _w(FOLD_METRIC_CTES, """
SELECT scaler, model, round(avg(accuracy), 6) AS acc, round(stddev_pop(accuracy), 6) AS acc_std,
       round(avg(precision), 6) AS prec, round(avg(recall), 6) AS rec, round(avg(f1), 6) AS f1
FROM fm GROUP BY scaler, model""")
ORACLES["model_scaler_grid"] = _w(FOLD_METRIC_CTES + """,
cs AS (SELECT scaler, model, avg(accuracy) AS acc FROM fm GROUP BY scaler, model)""", """
SELECT model, round(max(CASE WHEN scaler = 'none' THEN acc END), 6) AS "none",
       round(max(CASE WHEN scaler = 'rounded' THEN acc END), 6) AS rounded
FROM cs GROUP BY model""")
ORACLES["best_params"] = _w(FOLD_METRIC_CTES + """,
mp AS (SELECT scaler, params, avg(accuracy) AS mean_score FROM fm GROUP BY scaler, params),
rk AS (SELECT *, row_number() OVER (PARTITION BY scaler ORDER BY mean_score DESC, params) AS r FROM mp)""", """
SELECT scaler, params, round(mean_score, 6) AS mean_score FROM rk WHERE r = 1""")
ORACLES["best_model"] = _w(FOLD_METRIC_CTES + """,
am AS (SELECT arm, model, scaler, avg(accuracy) AS accuracy FROM fm GROUP BY arm, model, scaler),
rk AS (SELECT *, row_number() OVER (ORDER BY accuracy DESC, arm, model) AS r FROM am)""", """
SELECT arm, model, scaler, round(accuracy, 6) AS accuracy FROM rk WHERE r = 1""")


# ---------------------------------------------------------------- sinks, stage store, sets, contract
ORACLES["csv_scan"] = _w(V_CTE, """
SELECT variant_id, gene, CAST(position AS DOUBLE) AS position, population_name,
       CASE WHEN position % 3 = 2 THEN NULL ELSE region END AS region, allele,
       CAST(allele_freq AS DOUBLE) AS allele_freq, CAST(allele_count AS DOUBLE) AS allele_count FROM v""")
ORACLES["stream_score"] = _w(SPLIT_CTES + ",\n" + SCORE_CTES + """,
r AS (SELECT s.variant_id, coalesce(sum(coalesce(wt.w, 0.0)) * product(coalesce(CAST(fac.f AS DOUBLE), 1.0)), 0.0) AS raw
      FROM split s LEFT JOIN c ON s.variant_id = c.h LEFT JOIN wt ON c.code = wt.code
      LEFT JOIN fac ON s.population_name = fac.pop AND c.code = fac.code
      WHERE s.is_test GROUP BY 1)""", """
SELECT variant_id, round(raw, 6) AS acmg_raw, round(least(greatest((raw + 20) / 40, 0.0), 1.0), 6) AS acmg_norm,
       true AS same FROM r""")
ORACLES["csv_roundtrip"] = ORACLES["class_distribution"]
ORACLES["stage_roundtrip"] = ORACLES["group_metrics"]
_PW_ROWS = ", ".join(f"('{g}', '{p}')" for g, ps in {
    "Brand#11": ["DNA repair", "Cell cycle"], "Brand#12": ["DNA repair", "Cancer pathways"],
    "Brand#23": ["Metabolic pathways", "Pentose phosphate pathway"],
    "Brand#35": ["Metabolic pathways"]}.items() for p in ps)
ORACLES["sorted_sets"] = _w(LABELLED_CTES + f""",
gp AS (SELECT * FROM (VALUES {_PW_ROWS}) t(gene, pathway))""", """
SELECT (SELECT list_sort(list(DISTINCT population_name)) FROM lab2 WHERE population_name IS NOT NULL) AS populations,
       (SELECT list_sort(list(DISTINCT mapped_target)) FROM lab2) AS classes,
       (SELECT list_sort(list(DISTINCT gp.pathway)) FROM lab2 JOIN gp ON lab2.gene = gp.gene) AS pathways,
       (SELECT count(DISTINCT population_name) FROM lab2) AS n_populations""")
ORACLES["split_contract"] = _w(SPLIT_CTES, """
SELECT (SELECT count(*) FROM (SELECT variant_id FROM lab2 EXCEPT ALL SELECT variant_id FROM split)) AS missing,
       (SELECT count(*) FROM (SELECT variant_id FROM split EXCEPT ALL SELECT variant_id FROM lab2)) AS extra,
       (SELECT count(*) FROM (SELECT variant_id FROM split WHERE is_test
                              INTERSECT SELECT variant_id FROM split WHERE NOT is_test)) AS overlap""")

# ---------------------------------------------------------------- second-order boosting, first round
# all margins 0: p = 1/3, g = p - y, h = 2 p (1 - p); L1 = 1, L2 = 10, a side has a hessian of at least 1
_SOFT = lambda x: f"(sign({x}) * greatest(abs({x}) - 1, 0))"
ORACLES["boosted_one_round"] = _w(FEATURE_CTES + """,
gh AS (SELECT c.cls, CAST(1 AS DOUBLE) / 3 - CASE WHEN f.target_encoded = c.cls THEN 1 ELSE 0 END AS g,
              CAST(4 AS DOUBLE) / 9 AS h, f.gene, f.chromosome, f.region, CAST(f.allele_count AS DOUBLE) AS v
       FROM f, (VALUES (0), (1), (2)) c(cls)),
tot AS (SELECT cls, sum(g) AS g, sum(h) AS h FROM gh GROUP BY cls),
vals AS (SELECT cls, v, sum(g) AS g, sum(h) AS h FROM gh GROUP BY cls, v),
cuts AS (SELECT cls, sum(g) AS gl, sum(h) AS hl FROM gh GROUP BY cls, gene
         UNION ALL SELECT cls, sum(g), sum(h) FROM gh GROUP BY cls, chromosome
         UNION ALL SELECT cls, sum(g), sum(h) FROM gh GROUP BY cls, region
         UNION ALL SELECT cls, sum(g) OVER (PARTITION BY cls ORDER BY v), sum(h) OVER (PARTITION BY cls ORDER BY v) FROM vals),
sides AS (SELECT cuts.cls, gl, hl, g - gl AS gr, h - hl AS hr, g, h FROM cuts JOIN tot ON cuts.cls = tot.cls
          WHERE hl >= 1 AND h - hl >= 1)""", f"""
SELECT CAST(cls AS INT) AS cls, round(max(gain), 6) AS gain, round(max_by(w_left, gain), 6) AS w_left,
       round(max_by(w_right, gain), 6) AS w_right
FROM (SELECT cls, {_SOFT('gl')} ** 2 / (hl + 10) + {_SOFT('gr')} ** 2 / (hr + 10) - {_SOFT('g')} ** 2 / (h + 10) AS gain,
             -{_SOFT('gl')} / (hl + 10) AS w_left, -{_SOFT('gr')} / (hr + 10) AS w_right FROM sides) s
GROUP BY cls""")
