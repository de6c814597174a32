"""The same queries as plain SQL over the same tables.

Shared common table expressions spell out the tasks; none of them is derived
from the Spark code.
"""

from __future__ import annotations

from checks import tasks as t
from pupilage.config import TaskSpec
from pupilage.sources.reports import SCOPES

ORACLES: dict[str, str] = {}

WORD = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"
SPACE = r"[\s\x0B\p{Z}\x{0085}]+"


def u(text: str) -> str:
    return f"((('0x' || substr(sha256({text}), 1, 14))::UBIGINT >> 3)::DOUBLE / 9007199254740992.0::DOUBLE)"


def norm(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '{SPACE}', ' ', 'g'))"


def chance(kind: str, key: str = "id") -> str:
    return u(f"'{kind}:' || {key}")


def names(spec: TaskSpec) -> str:
    return "[" + ", ".join(f"'{n}'" for n in spec.label_names) + "]"


def fnv(text: str, dims: int) -> str:
    pairs = f"list_transform(range(0, length(hex({text})) // 2), lambda i: ('0x' || substr(hex({text}), (2 * i + 1)::BIGINT, 2))::UBIGINT)"
    step = "lambda h, b: ((xor(h, b)::UHUGEINT * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
    return f"(list_reduce(list_prepend(14695981039346656037::UBIGINT, {pairs}), {step}) % {dims})::BIGINT"


def softmax(values: str) -> str:
    return f"(SELECT list_transform(e, lambda v: v / list_sum(e)) FROM (SELECT list_transform(zs, lambda v: exp(v - list_max(zs))) AS e FROM (SELECT {values} AS zs)))"


def r6(expression: str, alias: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {alias}"


# ---- tasks -----------------------------------------------------------------------

DOC_ROWS = f"""
doc_rows AS (
  SELECT d.doc_id AS seq, 'doc-' || d.doc_id AS id, d.text, d.lang, d.source, NULL::VARCHAR AS grp,
         concat_ws(chr(10), 'text: ' || d.text, 'lang: ' || d.lang) AS rendered,
         CASE WHEN l.toxic = 1 THEN 2 WHEN l.quality = 1 THEN 0 WHEN l.doc_id IS NOT NULL THEN 1 END AS truth
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
doc_task AS (
  SELECT *, sha256({norm('rendered')}) AS content_hash,
         CASE WHEN truth IS NOT NULL AND {chance('gold')} < 0.25 THEN {names(t.DOCUMENTS)}[truth + 1] END AS gold
  FROM doc_rows)"""

CONV_ROWS = f"""
conv_rows AS (
  SELECT conv_id * 100000 + turn AS seq, conv_id || ':' || turn AS id, text, role, 'conv-' || conv_id AS grp, turn,
         'text: ' || text AS rendered, CASE role WHEN 'assistant' THEN 0 WHEN 'system' THEN 1 ELSE 2 END AS truth
  FROM conversations),
conv_task AS (
  SELECT *, sha256({norm('rendered')}) AS content_hash,
         CASE WHEN turn = 0 AND {chance('gold', 'grp')} < 0.2 THEN role END AS gold
  FROM conv_rows)"""

VEC_ROWS = f"""
vec_rows AS (
  SELECT vec_id AS seq, vec_id, 'vec-' || vec_id AS id, embedding::DOUBLE[] AS x, label, label AS truth,
         NULL::VARCHAR AS grp, 'key: vec-' || vec_id AS rendered
  FROM embeddings),
vec_task AS (
  SELECT *, sha256({norm('rendered')}) AS content_hash,
         CASE WHEN {chance('gold')} < 0.25 THEN {names(t.VECTORS)}[label + 1] END AS gold
  FROM vec_rows)"""


def probabilities(k: int) -> str:
    pick = f"(CASE WHEN {chance('flip')} < 0.15 THEN (truth + 1) % {k} ELSE truth END)"
    sure = f"(0.4::DOUBLE + 0.6::DOUBLE * {chance('sure')})"
    return f"list_transform(range(0, {k}), lambda i: CASE WHEN {pick} = i THEN {sure} ELSE (1.0::DOUBLE - {sure}) / {k - 1} END)"


def gated(spec: TaskSpec) -> str:
    """Columns from a list p of valid probabilities."""
    fallback = f"'{spec.abstain.label}'" if spec.teacher.uncertain == "abstain" else "NULL::VARCHAR"
    sure = (
        f"list_max(p) + 1e-9 >= {spec.teacher.min_confidence}::DOUBLE"
        f" AND list_max(p) - list_reverse_sort(p)[2] + 1e-9 >= {spec.teacher.min_margin}::DOUBLE"
    )
    best = f"{names(spec)}[list_position(p, list_max(p))]"
    return (
        f"CASE WHEN {sure} THEN 'accepted' ELSE 'uncertain' END AS g_status, {best} AS g_best,"
        f" CASE WHEN {sure} THEN {best} ELSE {fallback} END AS g_label,"
        f" list_max(p) AS g_top, list_max(p) - list_reverse_sort(p)[2] AS g_margin"
    )


def record_ctes(source: str, spec: TaskSpec) -> str:
    return f"""
asked AS (SELECT *, {probabilities(len(spec.labels))} AS p FROM {source} WHERE truth IS NOT NULL),
answered AS (SELECT *, {gated(spec)} FROM asked),
records AS (
  SELECT seq, id, CASE WHEN {chance('stale')} < 0.05 THEN sha256('old:' || id) ELSE content_hash END AS content_hash,
         '{spec.question_hash}' AS question_hash,
         'teacher-' || CASE WHEN {chance('who')} < 0.5 THEN 'a' ELSE 'b' END AS teacher,
         CASE WHEN {chance('error')} < 0.05 THEN 'error' ELSE g_status END AS status,
         CASE WHEN {chance('error')} >= 0.05 THEN g_best END AS teacher_label,
         CASE WHEN {chance('error')} >= 0.05 AND NOT (g_status = 'uncertain' AND {chance('drop')} < 0.3) THEN g_label END AS label,
         CASE WHEN {chance('error')} >= 0.05 THEN g_top END AS top
  FROM answered)"""


def outcome_ctes(source: str, spec: TaskSpec) -> str:
    """Row by row outcomes, then what is left of every row."""
    return f"""
joined AS (
  SELECT a.id, a.seq, a.content_hash, a.grp, a.gold, r.teacher,
         CASE WHEN r.id IS NULL THEN 'unlabeled'
              WHEN r.content_hash <> a.content_hash OR r.question_hash <> '{spec.question_hash}' THEN 'stale'
              WHEN r.status = 'error' THEN 'teacher_error'
              WHEN r.status = 'uncertain' AND list_position({names(spec)}, r.label) IS NULL THEN 'uncertain_dropped'
              WHEN r.status = 'uncertain' THEN 'uncertain_to_abstain'
              WHEN list_position({names(spec)}, r.label) IS NULL THEN 'teacher_error'
              ELSE 'accepted' END AS outcome,
         list_position({names(spec)}, r.label) - 1 AS record_index
  FROM {source} a LEFT JOIN records r ON a.id = r.id),
flagged AS (
  SELECT *, gold IS NULL AND (content_hash IN (SELECT content_hash FROM {source} WHERE gold IS NOT NULL)
                              OR coalesce(grp IN (SELECT grp FROM {source} WHERE gold IS NOT NULL AND grp IS NOT NULL), false)) AS overlap
  FROM joined),
candidates AS (
  SELECT id, seq, content_hash, grp, gold IS NOT NULL AS is_gold, teacher,
         CASE WHEN gold IS NOT NULL THEN list_position({names(spec)}, gold) - 1 ELSE record_index END AS idx
  FROM flagged
  WHERE gold IS NOT NULL OR (NOT overlap AND outcome IN ('accepted', 'uncertain_to_abstain'))),
copies AS (
  SELECT *, count(*) OVER w AS n, min(idx) OVER w <> max(idx) OVER w AS conflict,
         row_number() OVER (PARTITION BY content_hash ORDER BY seq) AS position,
         coalesce('group:' || grp, 'content:' || content_hash) AS split_key
  FROM candidates WINDOW w AS (PARTITION BY content_hash)),
kept AS (
  SELECT *, CASE WHEN is_gold THEN 'gold'
                 WHEN {u(f"'{spec.dataset.split_seed}' || chr(0) || split_key")} < {spec.dataset.holdout_fraction} THEN 'holdout'
                 ELSE 'train' END AS split
  FROM copies WHERE NOT conflict AND position = 1)"""


def split_report(source: str, rows: str, spec: TaskSpec) -> str:
    def pool(outcome: str) -> str:
        return f"(SELECT count(*) FROM flagged WHERE gold IS NULL AND NOT overlap AND outcome = '{outcome}')"

    return f"""
WITH {rows}, {record_ctes(source, spec)}, {outcome_ctes(source, spec)}
SELECT (SELECT count(*) FROM {source}) AS total,
       (SELECT count(*) FROM kept WHERE split = 'gold') AS gold,
       (SELECT count(*) FROM flagged WHERE overlap) AS gold_overlap_excluded,
       {pool('unlabeled')} AS unlabeled, {pool('teacher_error')} AS teacher_errors, {pool('stale')} AS stale_labels,
       {pool('uncertain_to_abstain')} AS uncertain_to_abstain, {pool('uncertain_dropped')} AS uncertain_dropped,
       (SELECT count(*) FROM copies WHERE NOT conflict AND position > 1) AS duplicates_removed,
       (SELECT count(*) FROM copies WHERE conflict) AS conflicts_dropped,
       0::BIGINT AS train_overlap_excluded,
       (SELECT count(*) FROM kept WHERE split = 'train') AS train,
       (SELECT count(*) FROM kept WHERE split = 'holdout') AS holdout"""


DOCS = DOC_ROWS
DOC_RECORDS = f"{DOC_ROWS}, {record_ctes('doc_task', t.DOCUMENTS)}"
DOC_SPLIT = f"{DOC_RECORDS}, {outcome_ctes('doc_task', t.DOCUMENTS)}"
CONV_SPLIT = f"{CONV_ROWS}, {record_ctes('conv_task', t.CONVERSATIONS)}, {outcome_ctes('conv_task', t.CONVERSATIONS)}"

# ---- identity --------------------------------------------------------------------

ORACLES["normalized_text"] = f"SELECT doc_id, sha256({norm('text')}) AS text_hash FROM documents"
ORACLES["tokenize"] = f"""
SELECT doc_id, len(w)::BIGINT AS n_tokens, sha256(coalesce(array_to_string(w, ' '), '')) AS tokens_hash
FROM (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents)"""
ORACLES["rendered_input"] = f"WITH {DOCS} SELECT id, sha256(rendered) AS rendered_hash FROM doc_task"
ORACLES["content_hash"] = f"WITH {DOCS} SELECT id, content_hash FROM doc_task"
ORACLES["unit_interval"] = f"WITH {DOCS} SELECT id, {u('id')} AS u FROM doc_task"
ORACLES["fnv_bucket"] = f"SELECT p_partkey, {fnv('p_name', 4096)} AS bucket FROM part"


def number(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN {x}::BIGINT::VARCHAR ELSE {x}::VARCHAR END"


ORACLES["number_text"] = f"""
SELECT l_orderkey, l_linenumber,
       min(concat_ws(chr(10), 'quantity: ' || {number('l_quantity')}, 'price: ' || {number('l_extendedprice')}, 'flag: ' || l_returnflag)) AS rendered,
       count(*) AS n
FROM lineitem GROUP BY ALL"""
CONV_KEY = "'group:' || grp"
ORACLES["split_assignment"] = f"""
WITH {CONV_ROWS} SELECT id, {CONV_KEY} AS split_key,
  CASE WHEN {u(f"'conversations' || chr(0) || {CONV_KEY}")} < 0.25 THEN 'holdout' ELSE 'train' END AS side FROM conv_task"""
ORACLES["cv_folds"] = f"""
WITH {CONV_ROWS} SELECT id, least(4, floor({u(f"'cv' || chr(0) || 'conversations' || chr(0) || {CONV_KEY}")} * 5))::BIGINT AS fold FROM conv_task"""
ORACLES["fingerprint_small"] = """
SELECT sha256(string_agg(n_nationkey || chr(9) || n_name || chr(9) || n_regionkey, chr(10) ORDER BY n_nationkey)) AS fingerprint FROM nation"""


def tree(level: str, above: str, parent: str) -> str:
    return f"{level} AS (SELECT {parent} AS k, sha256(string_agg(h, chr(10) ORDER BY k)) AS h FROM {above} GROUP BY 1)"


ORACLES["fingerprint_dataset"] = f"""
WITH {DOCS},
l0 AS (SELECT seq AS k, sha256(id || chr(9) || content_hash || chr(9) || '' || chr(9) || coalesce(gold, '')) AS h FROM doc_task),
{tree('l1', 'l0', 'k // 4096')}, {tree('l2', 'l1', 'k // 4096')}, {tree('l3', 'l2', 'k // 4096')}, {tree('l4', 'l3', 'k // 4096')}
SELECT sha256(string_agg(h, chr(10) ORDER BY k)) AS fingerprint FROM l4"""
ORACLES["fingerprint_incremental"] = ORACLES["fingerprint_dataset"]
ORACLES["fingerprint_labels"] = f"""
WITH {DOC_RECORDS},
l0 AS (SELECT id, substr(sha256(id), 1, 6) AS leaf,
              sha256(concat_ws(chr(9), id, content_hash, question_hash, teacher, status, coalesce(label, '-'))) AS h FROM records),
l1 AS (SELECT leaf AS k, sha256(string_agg(h, chr(10) ORDER BY id)) AS h FROM l0 GROUP BY 1),
{tree('l2', 'l1', 'substr(k, 1, 3)')}
SELECT sha256(string_agg(h, chr(10) ORDER BY k)) AS fingerprint FROM l2"""

# ---- validation -------------------------------------------------------------------

ORACLES["validate_input"] = """
SELECT doc_id, concat_ws('; ',
  CASE WHEN lang = 'de' THEN 'undeclared field(s) source' END,
  CASE WHEN length(text) > 4000 THEN 'text exceeds max_chars 4000' END,
  CASE WHEN source = 'src0' THEN 'lang is required' END,
  CASE WHEN source = 'src1' THEN 'flag must be of type boolean' END) AS violations
FROM documents"""
ORACLES["validate_rows"] = r"""
SELECT c_custkey, concat_ws('; ',
  CASE WHEN NOT regexp_matches(CASE WHEN c_acctbal < 0 THEN c_name || ' !' ELSE c_name END, '^[A-Za-z0-9._:-]{1,128}$')
       THEN 'id must match ^[A-Za-z0-9._:-]{1,128}$' END,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'gold ''never'' is not a declared label' END,
  CASE WHEN c_nationkey = 3 OR (c_nationkey = 4 AND length(c_name) * 10 > 128) THEN 'group must be 1-128 characters' END) AS violations
FROM customer"""
ORACLES["duplicate_ids"] = "SELECT o_custkey::VARCHAR AS id, count(*) AS copies FROM orders GROUP BY 1 HAVING count(*) > 1"
ORACLES["strict_keys"] = "SELECT event_id, CASE WHEN event_type = 'error' THEN 'a,z' ELSE '' END AS unknown_keys FROM events"
ORACLES["read_dataset"] = f'WITH {CONV_ROWS} SELECT id, content_hash, grp AS "group", gold FROM conv_task'

# ---- records, ledger -----------------------------------------------------------------

EVENT_RECORDS = """
log AS (
  SELECT event_id AS seq, 'user-' || user_id AS id, 'teacher-' || event_type AS teacher,
         CASE WHEN event_type = 'error' THEN 'error' WHEN value < 10 THEN 'uncertain' ELSE 'accepted' END AS status,
         CASE WHEN event_type <> 'error' AND value >= 5 THEN event_type END AS label
  FROM events)"""


def last_by(order: str) -> str:
    return f"""WITH {EVENT_RECORDS} SELECT id, seq, status, label, teacher FROM
(SELECT *, row_number() OVER (PARTITION BY id ORDER BY {order}) AS position FROM log) WHERE position = 1"""


ORACLES["latest_per_id"] = last_by("seq DESC")
ORACLES["label_store"] = last_by("(status = 'accepted') DESC, seq DESC")
ORACLES["merge_labels"] = last_by("(status = 'uncertain') DESC, seq DESC")
ORACLES["read_labels"] = f"WITH {DOC_RECORDS} SELECT id, content_hash, status, label, teacher, {r6('top', 'top')} FROM records"
ORACLES["join_labels"] = f"""
WITH {DOC_SPLIT} SELECT id, outcome, CASE WHEN outcome IN ('accepted', 'uncertain_to_abstain') THEN record_index END::BIGINT AS label_index FROM joined"""
ORACLES["current_labels"] = f"WITH {DOC_RECORDS} SELECT a.id FROM doc_task a JOIN records r ON a.id = r.id AND a.content_hash = r.content_hash"
PENDING = f"""
WITH {DOC_RECORDS}, waiting AS (
  SELECT a.id, a.seq FROM doc_task a LEFT JOIN records r ON a.id = r.id
  WHERE r.id IS NULL OR r.status = 'error' OR r.content_hash <> a.content_hash)"""
ORACLES["pending"] = f"{PENDING} SELECT id FROM waiting"
ORACLES["first_pending"] = f"{PENDING} SELECT seq, id FROM waiting ORDER BY seq LIMIT 25"
ORACLES["request_table"] = f"""
WITH {DOCS} SELECT seq, id, '{t.DOCUMENTS.question_hash}' AS question_hash, 'choice' AS question_type,
  'good: good rows | poor: poor rows | toxic: toxic rows' AS options, sha256(rendered) AS state_hash FROM doc_task"""
ORACLES["teacher_identities"] = f"WITH {DOC_RECORDS} SELECT string_agg(DISTINCT teacher, ',' ORDER BY teacher) AS teachers FROM records"
ORACLES["labeling_summary"] = f"""
WITH {DOC_RECORDS} SELECT count(*) AS selected, count(*) FILTER (status = 'accepted') AS accepted,
  count(*) FILTER (status = 'uncertain' AND label IS NOT NULL) AS uncertain_to_abstain,
  count(*) FILTER (status = 'uncertain' AND label IS NULL) AS uncertain_dropped,
  count(*) FILTER (status = 'error') AS errors FROM records"""
ORACLES["usage"] = f"""
WITH {DOC_RECORDS} SELECT r.teacher, count(*) AS requests, sum(len(regexp_extract_all(lower(a.text), '{WORD}')))::BIGINT AS input_tokens
FROM records r JOIN doc_task a ON a.id = r.id GROUP BY 1"""

LEDGER = f"""
{DOC_ROWS},
ledger_base AS (SELECT *, {chance('ledger')} AS lu, {probabilities(3)} AS full_p FROM doc_task WHERE truth IS NOT NULL),
last_lines AS (
  SELECT id, content_hash, CASE WHEN lu < 0.1 THEN 'failed' WHEN lu < 0.2 THEN 'forbidden' ELSE 'labeled' END AS status,
         CASE WHEN lu > 0.92 THEN list_transform(full_p, lambda v: v / 2) ELSE full_p END AS p
  FROM ledger_base),
decided AS (SELECT *, {gated(t.DOCUMENTS)}, abs(list_sum(p) - 1) <= 0.02 AS fits FROM last_lines),
found AS (
  SELECT a.id, CASE WHEN d.id IS NULL THEN 'missing' WHEN d.status <> 'labeled' THEN d.status WHEN NOT fits THEN 'invalid' ELSE g_status END AS outcome,
         d.status AS line_status, g_status, g_label, g_top, g_margin
  FROM doc_task a LEFT JOIN decided d ON a.id = d.id)"""
GATE_REASON = "below min_confidence 0.6 or min_margin 0.2"
ORACLES["ledger_import"] = f"""
WITH {LEDGER} SELECT id, outcome,
  CASE WHEN outcome = 'missing' THEN NULL WHEN outcome IN ('accepted', 'uncertain') THEN outcome ELSE 'error' END AS status,
  CASE WHEN outcome IN ('accepted', 'uncertain') THEN g_label END AS label,
  CASE WHEN outcome = 'missing' THEN NULL WHEN line_status = 'labeled' THEN 'ledger:m-2' ELSE 'ledger:m-1' END AS teacher,
  CASE WHEN outcome IN ('accepted', 'uncertain') THEN round(g_top, 6) + 0.0 END AS top,
  CASE WHEN outcome IN ('accepted', 'uncertain') THEN round(g_margin, 6) + 0.0 END AS margin,
  CASE outcome WHEN 'failed' THEN substr('ledger failed: ' || repeat('rate limited ', 30), 1, 200)
               WHEN 'forbidden' THEN 'ledger forbidden'
               WHEN 'invalid' THEN 'ledger invalid: probabilities are not a distribution over the labels'
               WHEN 'uncertain' THEN '{GATE_REASON}' END AS reason
FROM found"""
ORACLES["import_summary"] = f"""
WITH {LEDGER} SELECT 2 * (SELECT count(*) FROM labels) + (SELECT count(*) FROM benchmark) AS ledger_rows,
  count(*) FILTER (outcome <> 'missing') AS imported, count(*) FILTER (outcome = 'accepted') AS accepted,
  count(*) FILTER (outcome = 'uncertain' AND g_label IS NOT NULL) AS uncertain_to_abstain,
  count(*) FILTER (outcome = 'uncertain' AND g_label IS NULL) AS uncertain_dropped,
  count(*) FILTER (outcome = 'forbidden') AS forbidden, count(*) FILTER (outcome = 'failed') AS failed,
  count(*) FILTER (outcome = 'invalid') AS invalid, (SELECT count(*) FROM benchmark) AS unknown_ids,
  count(*) FILTER (outcome = 'missing') AS missing,
  string_agg(DISTINCT CASE WHEN outcome = 'missing' THEN NULL WHEN line_status = 'labeled' THEN 'ledger:m-2' ELSE 'ledger:m-1' END, ','
             ORDER BY CASE WHEN outcome = 'missing' THEN NULL WHEN line_status = 'labeled' THEN 'ledger:m-2' ELSE 'ledger:m-1' END) AS teacher
FROM found"""
ORACLES["unknown_ledger_ids"] = "SELECT 'ghost-' || item_id AS id FROM benchmark"
ORACLES["missing_rows"] = "SELECT 'doc-' || doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
ORACLES["validate_ledger"] = f"""
WITH {LEDGER}, broken AS (SELECT id, status, {chance('break')} AS bu FROM last_lines)
SELECT a.id, CASE
  WHEN b.id IS NULL THEN ''
  WHEN bu > 0.95 THEN 'unknown status waiting'
  WHEN status = 'labeled' AND bu < 0.1 THEN 'probabilities cover [good, poor], task labels are [good, poor, toxic]'
  WHEN status = 'labeled' AND bu BETWEEN 0.2 AND 0.3 THEN 'probabilities cover [good, poor, toxic], task labels are [good, poor, toxic]'
  ELSE '' END AS violations
FROM doc_task a LEFT JOIN broken b ON a.id = b.id"""
ORACLES["read_ledger"] = f"""
WITH {LEDGER} SELECT id, status, CASE WHEN status = 'labeled' THEN 'm-2' END AS answered_model FROM last_lines
UNION ALL SELECT 'ghost-' || item_id, 'forbidden', NULL FROM benchmark WHERE item_id % 2 = 0
UNION ALL SELECT 'ghost-' || item_id, 'forbidden', NULL FROM benchmark WHERE item_id % 2 = 1"""
ORACLES["import_labels"] = f"""
WITH {LEDGER}, broken AS (SELECT id, status, {chance('break')} AS bu FROM last_lines)
SELECT f.id, CASE WHEN outcome IN ('accepted', 'uncertain') THEN outcome ELSE 'error' END AS status,
  CASE WHEN outcome IN ('accepted', 'uncertain') THEN g_label END AS label,
  CASE WHEN line_status = 'labeled' THEN 'ledger:m-2' ELSE 'ledger:m-1' END AS teacher,
  CASE WHEN outcome IN ('accepted', 'uncertain') THEN round(g_top, 6) + 0.0 END AS top
FROM found f JOIN broken b ON f.id = b.id
WHERE NOT (bu > 0.95) AND NOT (b.status = 'labeled' AND (bu < 0.1 OR bu BETWEEN 0.2 AND 0.3))"""
ORACLES["read_labels_appended"] = f"WITH {DOC_RECORDS} SELECT id, status, teacher FROM records"
ORACLES["merge_with_late_append"] = last_by("(status <> 'accepted') DESC, seq DESC")
ORACLES["upsert_stream_replay"] = last_by("(status = 'accepted') DESC, seq DESC")
ORACLES["merge_conflict"] = f"""SELECT *, 2::INTEGER AS merges FROM ({last_by("(status = 'error') DESC, (status = 'uncertain') DESC, seq DESC")})"""
FEW = "(regexp_extract(id, '[0-9]+')::BIGINT % 50 = 0 AND status = 'accepted')"
ORACLES["merge_touched_buckets"] = f"SELECT *, 0::BIGINT AS needless, 0::BIGINT AS missed FROM ({last_by(f'{FEW} DESC, seq DESC')})"

# ---- split -----------------------------------------------------------------------------

ORACLES["dedupe"] = f"""
WITH {DOCS}, marked AS (
  SELECT id, content_hash, truth, count(*) OVER w AS copies, min(truth) OVER w <> max(truth) OVER w AS conflict,
         row_number() OVER (PARTITION BY content_hash ORDER BY seq) AS position
  FROM doc_task WHERE truth IS NOT NULL WINDOW w AS (PARTITION BY content_hash))
SELECT id, content_hash, truth::BIGINT AS label, copies FROM marked WHERE NOT conflict AND position = 1"""
ORACLES["dedupe_conflicts"] = f"""
WITH {DOCS}, hashes AS (SELECT content_hash, count(*) AS n, min(source) <> max(source) AS conflict FROM doc_task GROUP BY 1)
SELECT count(*) FILTER (NOT conflict) AS kept, coalesce(sum(n - 1) FILTER (NOT conflict), 0)::BIGINT AS duplicates_removed,
       coalesce(sum(n) FILTER (conflict), 0)::BIGINT AS conflicts_dropped FROM hashes"""
ORACLES["split_report"] = split_report("doc_task", DOC_ROWS, t.DOCUMENTS)
ORACLES["split_report_grouped"] = split_report("conv_task", CONV_ROWS, t.CONVERSATIONS)
ORACLES["split_kept"] = f"WITH {CONV_SPLIT} SELECT id, split, split_key, idx::BIGINT AS label_index FROM kept"
ORACLES["row_outcomes"] = f"""
WITH {DOC_SPLIT} SELECT f.id,
  CASE WHEN f.overlap THEN 'gold_overlap' WHEN c.conflict THEN 'conflict' WHEN c.position > 1 THEN 'duplicate'
       WHEN f.gold IS NOT NULL THEN 'gold' ELSE f.outcome END AS outcome, k.split
FROM flagged f LEFT JOIN copies c ON f.id = c.id LEFT JOIN kept k ON f.id = k.id"""
ORACLES["gold_overlap"] = f"""
WITH {CONV_ROWS} SELECT id, content_hash IN (SELECT content_hash FROM conv_task WHERE gold IS NOT NULL) AS gold_content,
  grp IN (SELECT grp FROM conv_task WHERE gold IS NOT NULL) AS gold_group FROM conv_task WHERE gold IS NULL"""
ORACLES["exclude_gold_overlap"] = f"""
WITH {DOCS} SELECT id FROM doc_task WHERE gold IS NULL AND content_hash NOT IN (SELECT content_hash FROM doc_task WHERE gold IS NOT NULL)"""
ORACLES["train_overlap"] = f"""
WITH {DOCS}, seen AS (SELECT content_hash FROM doc_task WHERE {chance('trained')} < 0.6)
SELECT id, content_hash IN (SELECT content_hash FROM seen) AS was_trained FROM doc_task WHERE {chance('trained')} >= 0.6"""
ORACLES["group_straddle"] = f"""
WITH {CONV_ROWS} SELECT grp AS "group" FROM (SELECT grp, {chance('alone')} < 0.25 AS held FROM conv_task) GROUP BY 1 HAVING count(DISTINCT held) > 1"""
ORACLES["disjoint_check"] = f"""
WITH {DOCS} SELECT content_hash FROM doc_task WHERE gold IS NULL INTERSECT SELECT content_hash FROM doc_task WHERE gold IS NOT NULL"""
ORACLES["union_parts"] = f"WITH {DOC_SPLIT} SELECT split, count(*) AS n FROM kept GROUP BY 1"
ORACLES["coverage_check"] = f"""
WITH {DOC_SPLIT}, seen AS (SELECT DISTINCT idx FROM kept WHERE split = 'train'),
every AS (SELECT unnest(range(0, 3)) AS i)
SELECT (SELECT count(*) FROM kept WHERE split = 'train') AS train, (SELECT count(*) FROM kept WHERE split = 'holdout') AS holdout,
       (SELECT count(*) FROM seen) AS train_labels,
       coalesce((SELECT string_agg({names(t.DOCUMENTS)}[i + 1], ',' ORDER BY i) FROM every WHERE i NOT IN (SELECT idx FROM seen)), '') AS labels_without_rows"""

# ---- teacher answers ---------------------------------------------------------------------

THREE = f"""
{VEC_ROWS},
three AS (SELECT vec_id, label, {softmax('list_transform(x[1:3], lambda v: v * 10.0::DOUBLE)')} AS p FROM vec_task)"""
ORACLES["valid_probabilities"] = f"WITH {THREE} SELECT vec_id, label NOT IN (3, 6) AS valid FROM three"
ORACLES["confidence_gate"] = f"""
WITH {THREE}, decided AS (SELECT vec_id, {gated(t.GATED)} FROM three)
SELECT vec_id, g_status AS status, g_best AS teacher_label, g_label AS label, {r6('g_top', 'top')}, {r6('g_margin', 'margin')} FROM decided"""
ORACLES["top_two"] = f"""
WITH {THREE} SELECT vec_id, (list_position(p, list_max(p)) - 1)::BIGINT AS best, {r6('list_max(p)', 'top')}, {r6('list_reverse_sort(p)[2]', 'second')} FROM three"""
ORACLES["answer_mapping"] = f"""
WITH {THREE} SELECT vec_id, {r6('p[1]', 'choice_0')}, {r6('p[2]', 'choice_1')}, {r6('p[3]', 'choice_2')},
  {r6('p[1]', 'score_0')}, {r6('p[2]', 'score_1')}, {r6('p[3]', 'score_2')}, {r6('1 - p[1]', 'noul_0')}, {r6('p[1]', 'noul_1')},
  list_min(p) <= 0.1::DOUBLE AS incomplete FROM three"""
ENTROPY = "list_sum(list_transform({p}, lambda v: CASE WHEN v > 0 THEN -v * ln(v) ELSE 0 END))"
ORACLES["calibrated_answers"] = f"""
WITH {VEC_ROWS},
five AS (SELECT vec_id, list_transform(x[1:5], lambda v: v * 4.0::DOUBLE) AS lg FROM vec_task),
heated AS (SELECT vec_id, {softmax('list_transform(lg, lambda v: v / 0.5::DOUBLE)')} AS p, {softmax('list_transform(lg, lambda v: v / 5.0::DOUBLE)')} AS q FROM five)
SELECT vec_id, 'o' || (list_position(p, list_max(p)) - 1) AS choice,
  round((1 - {ENTROPY.format(p='p')} / ln(5)) * 10000) / 10000 AS confidence,
  round(p[1] * 10000) / 10000 AS p_0, round(p[5] * 10000) / 10000 AS p_4,
  round((q[2] + 2 * q[3] + 3 * q[4] + 4 * q[5]) * 10000) / 10000 AS level, round(q[1] * 10000) / 10000 AS level_0
FROM heated"""
ORACLES["act_features"] = f"""
WITH {THREE} SELECT vec_id, {r6('list_max(p)', 'top')}, {r6('list_max(p) - list_reverse_sort(p)[2]', 'gap')},
  {r6('-list_sum(list_transform(p, lambda v: v * ln(greatest(v, 1e-9)))) / ln(3)', 'entropy')}, {r6('3.0::DOUBLE / 255', 'count_share')} FROM three"""
ORACLES["entropy_confidence"] = f"""
WITH {THREE} SELECT vec_id, {r6(f"greatest(0, least(1, 1 - {ENTROPY.format(p='p')} / ln(3)))", 'confidence')} FROM three"""
ORACLES["label_order"] = f"""WITH {VEC_ROWS} SELECT id, {r6('x[1] * 10', '"first"')}, {r6('x[10] * 10', '"last"')} FROM vec_task"""

# ---- features -------------------------------------------------------------------------------


def tokens(source: str, text: str, field: str) -> str:
    return f"""
split_words AS (SELECT *, regexp_extract_all(lower({text}), '{WORD}') AS w FROM {source}),
tokens AS (
  SELECT id, unnest(list_concat(list_concat(w, list_transform(w, lambda v: '{field}=' || v)),
                                list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS token
  FROM split_words)"""


def vectors(dims: int) -> str:
    return f"""
buckets AS (SELECT token, {fnv('token', dims)} AS bucket FROM (SELECT DISTINCT token FROM tokens)),
terms AS (SELECT k.id, b.bucket, count(*) AS n FROM tokens k JOIN buckets b USING (token) GROUP BY ALL),
unit AS (SELECT id, bucket, ln(1 + n) / greatest(sqrt(sum(ln(1 + n) * ln(1 + n)) OVER (PARTITION BY id)), 1e-12) AS value FROM terms)"""


CONV_TOKENS = f"{CONV_ROWS}, {tokens('conv_task', 'text', 'text')}"
CONV_UNIT = f"{CONV_TOKENS}, {vectors(512)}"
ORACLES["ngram_tokens"] = f"WITH {CONV_TOKENS} SELECT token, count(*) AS n FROM tokens GROUP BY 1"
ORACLES["term_counts"] = f'WITH {CONV_UNIT} SELECT id, bucket, n AS "count" FROM terms'
ORACLES["l2_normalize"] = f"WITH {CONV_UNIT} SELECT id, bucket, {r6('value', 'value')} FROM unit"
ORACLES["hashed_ngrams"] = ORACLES["l2_normalize"]


def three_layouts(where: str, more: str = "classifier") -> str:
    """Served predictions of a hashed, a logits and a hybrid student with weights from a rule."""
    bias = "c / 10.0::DOUBLE"
    logits = {
        "by-words": f"list_transform(range(0, 10), lambda c: {bias})",
        "by-logits": f"list_transform(range(0, 10), lambda c: 10.0::DOUBLE * x[c + 1] + {bias})",
        "by-both": f"list_transform(range(0, 10), lambda c: 0.2::DOUBLE * (10.0::DOUBLE * x[c + 1] - 0.25::DOUBLE) / 2 + 6.0::DOUBLE * (x[c + 21] - 0.25::DOUBLE) / 2 + {bias})",
    }
    parts = [f"SELECT id, vec_id, {k} AS place, '{name}' AS classifier, {softmax(z)} AS p FROM vec_task" for k, (name, z) in enumerate(logits.items())]
    return f"""
WITH {VEC_ROWS}, scored AS ({" UNION ALL ".join(parts)}),
judged AS (SELECT id, vec_id, place, classifier, list_max(p) AS top, 'c' || (list_position(p, list_max(p)) - 1) AS argmax FROM scored)
SELECT id, {more}, CASE WHEN top < 0.2 THEN 'c0' ELSE argmax END AS label, argmax, round(top * 10000) / 10000 AS confidence FROM judged WHERE {where}"""


ORACLES["score_many_dense"] = three_layouts("true")
ORACLES["score_named_dense"] = three_layouts("vec_id % 3 = place")
ORACLES["score_stream_dense"] = three_layouts("classifier = 'by-both'", f"CASE WHEN {chance('early')} < 0.5 THEN 0 ELSE 1 END::BIGINT AS batch")
ORACLES["dense_features"] = f"""
WITH {VEC_ROWS}, dense AS (SELECT content_hash, list_concat(list_transform(x[1:10], lambda v: v * 10.0::DOUBLE), x) AS d FROM vec_task),
cells AS (SELECT content_hash, unnest(d) AS v, generate_subscripts(d, 1) - 1 AS dimension FROM dense)
SELECT content_hash, dimension::BIGINT AS dimension, {r6('v', 'x')} FROM cells"""
ORACLES["scored_representations"] = f"""
WITH {DOCS} SELECT content_hash, arg_min(length(text), seq)::DOUBLE AS n_chars, arg_min(length(text), seq) / 2.0::DOUBLE AS half,
  'lengths-1' AS source_fingerprint FROM doc_task GROUP BY 1"""
ORACLES["attach_features"] = f"""
WITH {DOCS}, cache AS (SELECT content_hash, arg_min(len(regexp_extract_all(lower(text), '{WORD}')), seq)::BIGINT AS n_tokens FROM doc_task GROUP BY 1)
SELECT id, content_hash, n_tokens FROM doc_task JOIN cache USING (content_hash)"""
CELLS = f"{VEC_ROWS}, cells AS (SELECT vec_id, id, label, unnest(x) AS v, (generate_subscripts(x, 1) - 1)::BIGINT AS dimension FROM vec_task)"
ORACLES["feature_statistics"] = f"""
WITH {CELLS} SELECT dimension, {r6('avg(v)', 'mean')}, {r6('greatest(stddev_pop(v), 1e-6)', 'sd')} FROM cells GROUP BY 1"""
ORACLES["standardize"] = f"""
WITH {CELLS} SELECT vec_id, dimension, {r6('(v - avg(v) OVER d) / greatest(stddev_pop(v) OVER d, 1e-6)', 'value')} FROM cells WINDOW d AS (PARTITION BY dimension)"""
ORACLES["hybrid_features"] = f"""
WITH {VEC_ROWS}, dense AS (SELECT id, list_concat(list_transform(x[1:10], lambda v: v * 10.0::DOUBLE), x) AS d FROM vec_task),
cells AS (SELECT id, unnest(d) AS v, (generate_subscripts(d, 1) - 1)::BIGINT AS position FROM dense),
scaled AS (SELECT id, position, (v - avg(v) OVER p) / greatest(stddev_pop(v) OVER p, 1e-6) AS value FROM cells WINDOW p AS (PARTITION BY position)),
{tokens('vec_task', 'id', 'key')}, {vectors(64)}
SELECT id, position, {r6('value', 'value')} FROM scaled WHERE value <> 0
UNION ALL SELECT id, 74 + bucket, {r6('value', 'value')} FROM unit"""

# ---- training, metrics ----------------------------------------------------------------------

ORACLES["class_weights"] = """
WITH truth AS (SELECT CASE WHEN toxic = 1 THEN 2 WHEN quality = 1 THEN 0 ELSE 1 END AS label FROM labels),
counts AS (SELECT label, count(*) AS n FROM truth GROUP BY 1)
SELECT i::BIGINT AS label_index, coalesce(round((SELECT sum(n) FROM counts)::DOUBLE / ((SELECT count(*) FROM counts) * n), 6), 0.0) + 0.0 AS weight
FROM (SELECT unnest(range(0, 4)) AS i) LEFT JOIN counts ON label = i"""


def scored(weight: str, bias: str) -> str:
    return f"""{CELLS},
classes AS (SELECT unnest(range(0, 10)) AS c),
logits AS (SELECT vec_id, label, c, sum(v * ({weight})) + ({bias}) AS z FROM cells, classes GROUP BY vec_id, label, c),
shifted AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM logits),
scored AS (SELECT vec_id, label, c, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM shifted),
best AS (SELECT vec_id, label, arg_min(c, (-p, c)) AS predicted, max(p) AS top FROM scored GROUP BY ALL)"""


RULE = scored("((c * 31 + dimension * 7) % 11 - 5) / 10.0::DOUBLE", "((c * 5) % 7 - 3) / 10.0::DOUBLE")


def gradient(scored_ctes: str) -> str:
    return f"""
WITH {scored_ctes},
balance AS (SELECT label, (SELECT count(*) FROM vec_task)::DOUBLE / ((SELECT count(DISTINCT label) FROM vec_task) * count(*)) AS w FROM vec_task GROUP BY 1),
errors AS (SELECT s.vec_id, s.c, b.w * (s.p - CASE WHEN s.c = s.label THEN 1 ELSE 0 END) AS g FROM scored s JOIN balance b ON s.label = b.label)
SELECT e.c::BIGINT AS class_index, k.dimension, {r6('sum(e.g * k.v)', 'gradient')}, 0.0::DOUBLE AS loss, 0.0::DOUBLE AS weight
FROM errors e JOIN cells k ON e.vec_id = k.vec_id GROUP BY 1, 2
UNION ALL SELECT c::BIGINT, -1, {r6('sum(g)', 'gradient')}, 0.0, 0.0 FROM errors GROUP BY 1
UNION ALL SELECT -1, -1, 0.0, round(-sum(b.w * ln(greatest(s.p, 1e-12))), 6) + 0.0, round(sum(b.w), 6) + 0.0
FROM scored s JOIN balance b ON s.label = b.label WHERE s.c = s.label"""


ORACLES["gradient_at_zero"] = gradient(scored("0.0::DOUBLE", "0.0::DOUBLE"))
ORACLES["gradient_step"] = gradient(RULE)
ORACLES["adam_step"] = f"""
SELECT class_index, dimension, round(-0.05::DOUBLE * g / (abs(g) + 1e-8), 6) + 0.0 AS weight FROM (
  WITH {scored("0.0::DOUBLE", "0.0::DOUBLE")},
  balance AS (SELECT label, (SELECT count(*) FROM vec_task)::DOUBLE / ((SELECT count(DISTINCT label) FROM vec_task) * count(*)) AS w FROM vec_task GROUP BY 1),
  errors AS (SELECT s.vec_id, s.c, b.w * (s.p - CASE WHEN s.c = s.label THEN 1 ELSE 0 END) / (SELECT count(*) FROM vec_task) AS g FROM scored s JOIN balance b ON s.label = b.label)
  SELECT e.c::BIGINT AS class_index, k.dimension, sum(e.g * k.v) AS g FROM errors e JOIN cells k ON e.vec_id = k.vec_id GROUP BY 1, 2)"""
ORACLES["predict_probabilities"] = f"WITH {RULE} SELECT vec_id, c::BIGINT AS class_index, {r6('p', 'p')} FROM scored"
ORACLES["prediction_rows"] = f"""
WITH {RULE} SELECT b.vec_id, 'vector-class' AS classifier, '1' AS version,
  CASE WHEN top < 0.2 THEN 'c0' ELSE 'c' || predicted END AS label, 'c' || predicted AS argmax,
  round(top * 10000) / 10000 AS confidence, top < 0.2 AS abstained, round(s.p * 10000) / 10000 AS p_c3
FROM best b JOIN scored s ON b.vec_id = s.vec_id AND s.c = 3"""
GRID = "grid AS (SELECT r, q FROM (SELECT unnest(range(0, {k})) AS r), (SELECT unnest(range(0, {k})) AS q))"
ORACLES["save_load_predict"] = ORACLES["prediction_rows"]
ORACLES["fit_optimum"] = "SELECT count(*) AS examples, count(DISTINCT label) AS classes, true AS converged, true AS flat FROM embeddings"
ORACLES["compatible_sources"] = """
SELECT source, count(*) AS rows, CASE source WHEN 'src0' THEN 'words,zero' WHEN 'src1' THEN 'one,words' ELSE 'words' END AS students
FROM documents GROUP BY source"""
ORACLES["confusion"] = f"""
WITH {RULE}, {GRID.format(k=10)}
SELECT r::BIGINT AS reference, q::BIGINT AS predicted, count(vec_id) AS n FROM grid LEFT JOIN best ON label = r AND predicted = q GROUP BY 1, 2"""


def class_table(k: int) -> str:
    """From a table pairs(ref, pred)."""
    return f"""
per_class AS (
  SELECT i, (SELECT count(*) FROM pairs WHERE ref = i) AS support, (SELECT count(*) FROM pairs WHERE pred = i) AS guessed,
         (SELECT count(*) FROM pairs WHERE ref = i AND pred = i) AS hits
  FROM (SELECT unnest(range(0, {k})) AS i)),
ratios AS (SELECT *, CASE WHEN guessed = 0 THEN 0.0 ELSE hits::DOUBLE / guessed END AS precision, CASE WHEN support = 0 THEN 0.0 ELSE hits::DOUBLE / support END AS recall FROM per_class),
scores AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM ratios)"""


OVERALL = f"""
SELECT sum(support)::BIGINT AS examples, {r6('CASE WHEN sum(support) = 0 THEN 0.0 ELSE sum(hits)::DOUBLE / sum(support) END', 'accuracy')},
  {r6('coalesce(avg(f1) FILTER (support > 0), 0.0)', 'macro_f1')} FROM scores"""
RULE_CLASSES = f"{RULE}, pairs AS (SELECT label AS ref, predicted AS pred FROM best), {class_table(10)}"
ORACLES["class_metrics"] = f"""
WITH {RULE_CLASSES} SELECT i::BIGINT AS label_index, {r6('precision', 'precision')}, {r6('recall', 'recall')}, {r6('f1', 'f1')}, support FROM scores"""
ORACLES["metrics_overall"] = f"WITH {RULE_CLASSES} {OVERALL}"
ORACLES["majority_label"] = """
WITH truth AS (SELECT CASE WHEN toxic = 1 THEN 2 WHEN quality = 1 THEN 0 ELSE 1 END AS label FROM labels)
SELECT label::BIGINT AS label_index, count(*) AS n FROM truth GROUP BY label ORDER BY n DESC, label LIMIT 1"""
ORACLES["majority_baseline"] = f"""
WITH {DOC_SPLIT},
majority AS (SELECT idx FROM kept WHERE split = 'train' GROUP BY 1 ORDER BY count(*) DESC, idx LIMIT 1),
pairs AS (SELECT idx AS ref, (SELECT idx FROM majority) AS pred FROM kept WHERE split = 'gold'), {class_table(3)} {OVERALL}"""
ORACLES["abstain_rate"] = f"WITH {RULE} SELECT {r6('avg(CASE WHEN top < 0.2 AND predicted <> 0 THEN 1.0 ELSE 0.0 END)', 'abstain_rate')} FROM best"


def teacher_view(view: str, column: str) -> str:
    return f"""
SELECT '{view}' AS view, * FROM (
  WITH pairs AS (SELECT list_position({names(t.DOCUMENTS)}, gold) - 1 AS ref, list_position({names(t.DOCUMENTS)}, {column}) - 1 AS pred
                 FROM said WHERE {column} IS NOT NULL), {class_table(3)} {OVERALL})"""


ORACLES["teacher_on_gold"] = f"""
WITH {DOC_RECORDS}, said AS (
  SELECT a.gold, r.teacher_label, r.label FROM doc_task a JOIN records r ON a.id = r.id AND a.content_hash = r.content_hash WHERE a.gold IS NOT NULL)
{teacher_view('raw', 'teacher_label')} UNION ALL {teacher_view('gated', 'label')}"""
ORACLES["zero_shot"] = f"""
WITH {VEC_ROWS}, pairs AS (SELECT label AS ref, list_position(x[1:10], list_max(x[1:10])) - 1 AS pred FROM vec_task WHERE gold IS NOT NULL), {class_table(10)} {OVERALL}"""
ORACLES["best_candidate"] = "SELECT event_id::DOUBLE AS l2, value AS accuracy FROM events ORDER BY value DESC, event_id DESC LIMIT 1"

# ---- order, latency, parity -------------------------------------------------------------------


def run_lengths(is_error: str) -> str:
    return f"""
marked AS (SELECT event_id, user_id, {is_error} AS bad FROM events),
islands AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM marked),
lengths AS (SELECT event_id, user_id, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY event_id)::BIGINT AS run_length FROM islands)"""


ORACLES["error_runs"] = f"""WITH {run_lengths("event_type = 'error'")} SELECT event_id, run_length FROM lengths"""
ORACLES["stop_after_errors"] = f"""
WITH {run_lengths("event_type IN ('error', 'view')")}, stops AS (SELECT user_id, min(event_id) AS stop FROM lengths WHERE run_length >= 5 GROUP BY 1)
SELECT l.event_id, l.user_id FROM lengths l LEFT JOIN stops s ON l.user_id = s.user_id WHERE s.stop IS NULL OR l.event_id <= s.stop"""
ORACLES["latency_summary"] = """
WITH ordered AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS position, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, n, max(value) FILTER (position = least(n - 1, floor(n * 0.5::DOUBLE))) AS p50,
  max(value) FILTER (position = least(n - 1, floor(n * 0.95::DOUBLE))) AS p95, min(value) AS "min", max(value) AS "max"
FROM ordered GROUP BY event_type, n"""
ORACLES["keyed_lookup"] = """
SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""
ORACLES["answer_parity"] = f"""
WITH {THREE},
sides AS (SELECT vec_id, label, p, list_transform(p, lambda v: round(v, 1)) AS q FROM three),
judged AS (SELECT vec_id::VARCHAR AS "case", label NOT IN (1, 2) AS answered,
  list_position(p, list_max(p)) = list_position(q, list_max(q)) AS same,
  greatest(abs(p[1] - q[1]), abs(p[2] - q[2]), abs(p[3] - q[3])) AS gap FROM sides)
SELECT "case", answered, answered AND same AS same_choice, CASE WHEN answered THEN round(gap, 6) + 0.0 ELSE 0.0 END AS max_gap,
  answered AND same AND gap <= 0.02 AS agrees FROM judged"""

# ---- serving ---------------------------------------------------------------------------------------


def hashed_scores(shift: int) -> str:
    """Probabilities of the rule student over conversation n-grams."""
    return f"{CONV_UNIT}, {rule_scores(shift)}"


def rule_scores(shift: int) -> str:
    return f"""
classes AS (SELECT unnest(range(0, 3)) AS c),
logits AS (SELECT r.id, c, coalesce(sum(u.value * (((c + {shift}) * 31 + u.bucket * 7) % 11 - 5) / 10.0::DOUBLE), 0.0) AS z
           FROM conv_task r CROSS JOIN classes LEFT JOIN unit u ON r.id = u.id GROUP BY r.id, c),
shifted AS (SELECT *, exp(z - max(z) OVER (PARTITION BY id)) AS e FROM logits),
scored AS (SELECT id, c, e / sum(e) OVER (PARTITION BY id) AS p FROM shifted),
best AS (SELECT id, {names(t.CONVERSATIONS)}[arg_min(c, (-p, c)) + 1] AS label, max(p) AS top FROM scored GROUP BY 1)"""


def served(shift: int, name: str, where: str = "true") -> str:
    return f"""
SELECT * FROM (WITH {hashed_scores(shift)} SELECT b.id, '{name}' AS classifier, b.label, round(top * 10000) / 10000 AS confidence
FROM best b JOIN conv_task r ON b.id = r.id WHERE {where})"""


ORACLES["evaluate_student"] = f"""
WITH {CONV_SPLIT}, {tokens('conv_task', 'text', 'text')}, {vectors(512)}, {rule_scores(0)},
majority AS (SELECT idx FROM kept WHERE split = 'train' GROUP BY 1 ORDER BY count(*) DESC, idx LIMIT 1),
scored_rows AS (
  SELECT k.id, k.split, k.idx AS ref, list_position({names(t.CONVERSATIONS)}, b.label) - 1 AS pred, r.content_hash IS NOT NULL AS current,
         list_position({names(t.CONVERSATIONS)}, r.teacher_label) - 1 AS raw, list_position({names(t.CONVERSATIONS)}, r.label) - 1 AS gated
  FROM kept k JOIN best b ON k.id = b.id LEFT JOIN records r ON k.id = r.id AND k.content_hash = r.content_hash WHERE k.split <> 'train'),
pairs AS (
  SELECT position, ref, pred FROM scored_rows, (SELECT unnest([0, 1]) AS position) WHERE split = 'holdout'
  UNION ALL SELECT 2, ref, (SELECT idx FROM majority) FROM scored_rows WHERE split = 'holdout'
  UNION ALL SELECT position, ref, pred FROM scored_rows, (SELECT unnest([3, 4]) AS position) WHERE split = 'gold'
  UNION ALL SELECT 5, ref, raw FROM scored_rows WHERE split = 'gold' AND raw IS NOT NULL
  UNION ALL SELECT 6, ref, gated FROM scored_rows WHERE split = 'gold' AND gated IS NOT NULL
  UNION ALL SELECT 8, ref, (SELECT idx FROM majority) FROM scored_rows WHERE split = 'gold'),
by_class AS (
  SELECT position, i, count(*) FILTER (ref = i) AS support, count(*) FILTER (pred = i) AS guessed, count(*) FILTER (ref = i AND pred = i) AS hits
  FROM pairs, (SELECT unnest(range(0, 3)) AS i) GROUP BY 1, 2),
by_f1 AS (SELECT *, CASE WHEN hits = 0 THEN 0.0 ELSE 2.0 * hits / (guessed + support) END AS f1 FROM by_class)
SELECT position::BIGINT AS position, sum(support)::BIGINT AS n, {r6('sum(hits)::DOUBLE / sum(support)', 'accuracy')}, {r6('avg(f1) FILTER (support > 0)', 'macro_f1')}
FROM by_f1 GROUP BY 1"""
ORACLES["score_many"] = f"{served(0, 'first')} UNION ALL {served(1, 'second')}"
ORACLES["score_named"] = f"""{served(0, 'first', "role = 'user'")} UNION ALL {served(1, 'second', "role <> 'user'")}"""
ORACLES["write_predictions"] = f"WITH {hashed_scores(0)} SELECT id, label, label AS argmax, false AS abstained FROM best"
ORACLES["score_stream"] = ORACLES["write_predictions"]
ORACLES["quarantine_stream"] = f"WITH {CONV_ROWS} SELECT id, 'text is required' AS violations FROM conv_task WHERE role = 'system'"
ORACLES["upsert_stream"] = ORACLES["latest_per_id"]
ORACLES["pending_stream"] = ORACLES["pending"]
ORACLES["pending_stream_fresh"] = f"""
WITH {DOC_RECORDS}
SELECT a.id, (a.seq % 2)::BIGINT AS half FROM doc_task a LEFT JOIN records r ON a.id = r.id AND (a.seq % 2 = 1 OR {chance('early', 'a.id')} < 0.5)
WHERE r.id IS NULL OR r.status = 'error' OR r.content_hash <> a.content_hash"""
ORACLES["label_with_teacher"] = f"""
WITH {CONV_ROWS}, said AS (SELECT id, (length(text) % 97) / 97.0::DOUBLE AS s FROM conv_task),
spread AS (SELECT id, [s, (1.0::DOUBLE - s) / 2, (1.0::DOUBLE - s) / 2] AS p FROM said),
decided AS (SELECT id, {gated(t.CONVERSATIONS)} FROM spread)
SELECT id, g_status AS status, g_best AS teacher_label, g_label AS label, {r6('g_top', 'top')}, {r6('g_margin', 'margin')} FROM decided"""

# ---- selection and the whole report ------------------------------------------------------

MODELS = "[" + ", ".join(f"'{r}/{m}'" for r, m in SCOPES) + "]"
ORACLES["full_report"] = f"""
WITH {DOC_SPLIT},
scored AS (
  SELECT k.split, k.idx AS ref, list_position({names(t.DOCUMENTS)}, r.teacher_label) AS raw, list_position({names(t.DOCUMENTS)}, r.label) AS gated
  FROM kept k LEFT JOIN records r ON k.id = r.id AND k.content_hash = r.content_hash WHERE k.split <> 'train'),
pairs AS (
  SELECT position, ref FROM scored, (SELECT unnest([0, 1, 2]) AS position) WHERE split = 'holdout'
  UNION ALL SELECT position, ref FROM scored, (SELECT unnest([3, 4, 8]) AS position) WHERE split = 'gold'
  UNION ALL SELECT 5, ref FROM scored WHERE split = 'gold' AND raw IS NOT NULL
  UNION ALL SELECT 6, ref FROM scored WHERE split = 'gold' AND gated IS NOT NULL),
counted AS (SELECT {MODELS}[position + 1] AS model, ref FROM pairs),
split_counters AS ({split_report("doc_task", DOC_ROWS, t.DOCUMENTS)})
SELECT 'metrics' AS section, model, 'n' AS name, count(*)::DOUBLE AS value, NULL::VARCHAR AS text FROM counted GROUP BY model
UNION ALL SELECT 'confusion', model, 'all', count(*)::DOUBLE, NULL FROM counted GROUP BY model
UNION ALL SELECT 'labels', model, {names(t.DOCUMENTS)}[i + 1] || '.support', count(*) FILTER (ref = i)::DOUBLE, NULL FROM counted, (SELECT unnest(range(0, 3)) AS i) GROUP BY model, i
UNION ALL SELECT 'split', NULL, name, value::DOUBLE, NULL FROM (UNPIVOT split_counters ON COLUMNS(*) INTO NAME name VALUE value)
UNION ALL SELECT 'summary', NULL, 'teacher', NULL, string_agg(DISTINCT teacher, ',' ORDER BY teacher) FROM kept WHERE split <> 'gold'"""
ORACLES["selection_folds"] = f"""
WITH {DOC_SPLIT},
placed AS (SELECT least(4, floor({u(f"'cv' || chr(0) || '{t.DOCUMENTS.dataset.split_seed}' || chr(0) || split_key")} * 5))::BIGINT AS fold FROM kept WHERE split = 'train')
SELECT l2, fold, count(*) AS tested, true AS chosen, true AS fits FROM placed, (SELECT unnest([0.0001, 0.01, 1.0]::DOUBLE[]) AS l2) GROUP BY l2, fold"""
