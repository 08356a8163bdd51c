"""SQL fragments shared by the counterparts (DuckDB dialect)."""

from __future__ import annotations

from seqloom.fixed import PROPERTIES, RESIDUES, SEED, TARGETS
from seqloom.plans.inference import CLASS_BY_SLOT


def residues(text: str) -> str:
    return (
        f"regexp_replace(upper(regexp_replace({text}, '[^a-zA-Z]', '', 'g')), '[^{RESIDUES}]', '', 'g')"
    )


def hex_draw(*parts: str) -> str:
    return f"md5(concat_ws(':', {', '.join(parts)}))"


def int_draw(*parts: str) -> str:
    return f"('0x' || substr({hex_draw(*parts)}, 1, 15))::BIGINT"


def count(seq: str, letters: str) -> str:
    return f"(length({seq}) - length(translate({seq}, '{letters}', '')))"


def fraction(seq: str, letters: str) -> str:
    return f"({count(seq, letters)}::DOUBLE / nullif(length({seq}), 0))"


SEED_SQL = f"'{SEED}'"

SEQS = f"""seqs AS MATERIALIZED (
  SELECT doc_id, lang, source, source AS type, doc_id % (SELECT count(*) FROM customer) AS idv_id,
         {residues('text')} AS sequence
  FROM documents)"""

MEAS = """meas AS MATERIALIZED (
  SELECT o_custkey AS idv_id,
         avg(l_quantity) AS toughness, stddev_samp(l_quantity) AS toughness_sd,
         avg(l_extendedprice) AS "E", stddev_samp(l_extendedprice) AS "E_sd",
         avg(l_discount) AS strength, stddev_samp(l_discount) AS strength_sd,
         avg(l_tax) AS strain, CASE WHEN o_custkey % 7 <> 0 THEN stddev_samp(l_tax) END AS strain_sd
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey)"""

COMPLETE = " AND ".join(f'"{p}" IS NOT NULL' for p in PROPERTIES)

PAIRS = f"""{SEQS},
{MEAS},
pairs AS MATERIALIZED (
  SELECT s.*, {', '.join(f'm."{p}"' for p in PROPERTIES)},
         CASE WHEN starts_with(type, 'src1') THEN 'src1' WHEN starts_with(type, 'src2') THEN 'src2'
              WHEN starts_with(type, 'src3') THEN 'src3' ELSE 'other' END AS family_group
  FROM seqs s JOIN meas m USING (idv_id) WHERE {COMPLETE})"""

_SCALED = ", ".join(
    f'("{p}" - (SELECT min("{p}") FROM pairs)) / (CASE WHEN (SELECT max("{p}") = min("{p}") FROM pairs) THEN 1.0 '
    f'ELSE (SELECT max("{p}") - min("{p}") FROM pairs) END)'
    for p in PROPERTIES
)

NORMALISED = f"""{PAIRS},
norm AS MATERIALIZED (SELECT *, [{_SCALED}] AS target FROM pairs)"""


def prediction(seq: str) -> str:
    cells = ", ".join(f"printf('%.3f', {fraction(seq, c)})::DOUBLE" for c in CLASS_BY_SLOT)
    return f"[{cells}]"


PREDICTED = f"""{NORMALISED},
pred AS MATERIALIZED (SELECT *, {prediction('sequence')} AS prediction FROM norm)"""

REMEMBERED = f"""{NORMALISED},
pred AS MATERIALIZED (
  SELECT *, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
                 THEN [round(x, 3) for x in target] ELSE {prediction('sequence')} END AS prediction
  FROM norm)"""

VECTORS = f"""truth AS MATERIALIZED (SELECT vec_id, label, [{', '.join('(' + ' + '.join(f'embedding[{8 * s + e}]::DOUBLE' for e in range(1, 9)) + ') / 8' for s in range(8))}] AS target FROM embeddings),
vecs AS MATERIALIZED (
  SELECT vec_id, label, target, prediction FROM truth JOIN (
    SELECT label, [{', '.join(f'avg(target[{i}])' for i in range(1, 9))}] AS prediction FROM truth GROUP BY label
  ) USING (label))"""

TARGETS_SQL = "targets AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{name}', {[float(x) for x in vector]}::DOUBLE[], {score}::DOUBLE)" for name, (vector, score) in TARGETS.items()
) + ') AS t("set", target, published_r2))'

_KIND = f"{int_draw(SEED_SQL, 'doc_id', chr(39) + 'kind' + chr(39))} % 20"
_SET = f"{int_draw(SEED_SQL, 'doc_id', chr(39) + 'set' + chr(39))} % {len(TARGETS)}"

ATTEMPTS = f"""{SEQS},
attempts AS MATERIALIZED (
  SELECT {list(TARGETS)}[1 + {_SET}] AS "set", doc_id AS attempt,
         CASE WHEN {_KIND} = 0 THEN sequence WHEN {_KIND} = 1 THEN '[' || sequence || 'B1]'
              WHEN {_KIND} < 9 THEN '[' || sequence || ']'
              ELSE '[' || regexp_replace(sequence, 'TH', '', 'g') || ']' END AS text
  FROM seqs),
parsed AS MATERIALIZED (
  SELECT "set", attempt, CASE WHEN position('[' IN text) = 0 THEN 'unparseable'
         WHEN NOT regexp_full_match(text[2:-2], '[{RESIDUES}]+') THEN 'invalid_aa' ELSE 'parsed' END AS status,
         CASE WHEN position('[' IN text) > 0 AND regexp_full_match(text[2:-2], '[{RESIDUES}]+') THEN text[2:-2] END AS sequence
  FROM attempts)"""


def r2(target: str, predicted: str) -> str:
    """Within-vector R2 of two list columns."""
    residual = f"list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip({target}, {predicted})])"
    return (
        f"(CASE WHEN {spread(target)} = 0 THEN (CASE WHEN {residual} = 0 THEN 1.0 ELSE 0.0 END) "
        f"ELSE 1.0 - {residual} / {spread(target)} END)"
    )


def spread(target: str) -> str:
    return f"list_sum([(x - list_avg({target})) * (x - list_avg({target})) for x in {target}])"


def mae(target: str, predicted: str) -> str:
    return f"list_avg([abs(z[1] - z[2]) for z in list_zip({target}, {predicted})])"


def rmse(target: str, predicted: str) -> str:
    return f"sqrt(list_avg([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip({target}, {predicted})]))"


POOL = f"""{ATTEMPTS},
{TARGETS_SQL},
pool AS MATERIALIZED (
  SELECT "set", attempt AS candidate_index, sequence, length(sequence) AS length,
         sequence NOT IN (SELECT sequence FROM seqs) AS novel_exact, TRUE AS forward_parsed,
         prediction, {r2('target', 'prediction')} AS r2, {mae('target', 'prediction')} AS mae,
         {rmse('target', 'prediction')} AS rmse, target, published_r2
  FROM (SELECT *, {prediction('sequence')} AS prediction FROM parsed WHERE status = 'parsed') JOIN targets USING ("set")),
scored AS MATERIALIZED (SELECT * FROM pool WHERE novel_exact AND r2 IS NOT NULL)"""


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def across(y: str, p: str) -> str:
    """Regression R2 as an aggregate."""
    return (
        f"(CASE WHEN var_pop({y}) * count({y}) = 0 THEN (CASE WHEN sum(({y}-{p})*({y}-{p})) = 0 THEN 1.0 ELSE 0.0 END) "
        f"ELSE 1.0 - sum(({y}-{p})*({y}-{p})) / nullif(var_pop({y}) * count({y}), 0) END)"
    )


def pearson(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def slot_name(slot: str) -> str:
    """Property name of a 0-based slot."""
    return f"{PROPERTIES}[{slot} + 1]"


def slots(source: str, *columns: str, keep: str = "") -> str:
    """Long form of list columns: (keep, slot, columns...)."""
    picked = ", ".join(f"{c}[i + 1] AS {c}" for c in columns)
    keep = keep + ", " if keep else ""
    return f"(SELECT {keep}i AS slot, {picked} FROM {source}, range(8) AS r(i))"

