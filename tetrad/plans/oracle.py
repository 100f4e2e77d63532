"""DuckDB SQL for each registered query (the correctness oracle).

The fixture definitions are repeated here in SQL (CTEs) so the oracle
reads only the driver's tables. Doubles are rounded like the Spark side.
"""

from __future__ import annotations

from tetrad import dims
from tetrad.operators.epochs import BETAS, EPSILON

_CLASSES = ", ".join(f"({i}, '{n}')" for i, n in enumerate(dims.CLASS_NAMES))
_PRIORS = ", ".join(
    [f"('prop', '{t}', CAST({f} AS DOUBLE))" for t, f in dims.PRIOR_PROPORTIONAL.items()]
    + [f"('bal', '{t}', CAST({f} AS DOUBLE))" for t, f in dims.PRIOR_BALANCED.items()])


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


CLASSES = f"classes(idx, name) AS (VALUES {_CLASSES})"
PRIORS = f"priors(variant, type, real_frac) AS (VALUES {_PRIORS})"
POSTS = """posts AS (
  SELECT d.doc_id AS post_id, d.text AS posts, upper(c.name) AS type
  FROM documents d JOIN classes c
    ON c.idx = CAST((CAST(d.doc_id * 7 + floor(d.doc_id / 5) AS BIGINT) % 23) % 16 AS INTEGER))"""
COUNTS = "counts AS (SELECT type, count(posts) AS posts FROM posts GROUP BY type)"
PLAN = """plan AS (
  SELECT j.variant, j.type, j.posts, j.real_frac, m.maximal_count,
         CAST(floor(j.real_frac * m.maximal_count) AS BIGINT) AS sample_cnt
  FROM (SELECT p.variant, c.type, c.posts, p.real_frac
        FROM counts c JOIN priors p ON p.type = c.type) j
  JOIN (SELECT p.variant, CAST(floor(min(c.posts / p.real_frac)) AS BIGINT) AS maximal_count
        FROM counts c JOIN priors p ON p.type = c.type GROUP BY p.variant) m
    ON m.variant = j.variant)"""
SAMPLED = """sampled AS (
  SELECT s.variant, s.post_id, s.posts, s.type, s.order_key FROM (
    SELECT v.variant, p.*, md5(CAST(p.post_id AS VARCHAR) || ':2') AS order_key,
           row_number() OVER (PARTITION BY v.variant, p.type
                              ORDER BY md5(CAST(p.post_id AS VARCHAR) || ':2'), p.post_id) AS rn
    FROM posts p CROSS JOIN (VALUES ('bal'), ('prop')) v(variant)) s
  JOIN plan ON plan.variant = s.variant AND plan.type = s.type
  WHERE s.rn <= plan.sample_cnt)"""
VARIANTS = """variants AS (
  SELECT 'raw' AS variant, post_id, posts, type FROM posts
  UNION ALL SELECT variant, post_id, posts, type FROM sampled)"""
SPLIT = """split AS (
  SELECT variant, post_id, posts, type, split_key,
         CASE WHEN rn <= floor(n * CAST(0.9 AS DOUBLE)) THEN 'train' ELSE 'eval' END AS split
  FROM (SELECT *, md5(CAST(post_id AS VARCHAR) || ':split:2') AS split_key,
               row_number() OVER (PARTITION BY variant
                                  ORDER BY md5(CAST(post_id AS VARCHAR) || ':split:2'), post_id) AS rn,
               count(*) OVER (PARTITION BY variant) AS n
        FROM variants))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BASE = [CLASSES, PRIORS, POSTS]
DATASET = BASE + [COUNTS, PLAN, SAMPLED, VARIANTS, SPLIT]

ORACLE: dict[str, str] = {}

ORACLE["class_counts"] = with_(*BASE, COUNTS) + "SELECT type, posts FROM counts"

ORACLE["resample_plan"] = with_(*BASE, COUNTS, PLAN) + (
    "SELECT variant, type, posts, real_frac, maximal_count, sample_cnt FROM plan")

for _v, _name in (("bal", "resample_balanced"), ("prop", "resample_proportional")):
    ORACLE[_name] = with_(*BASE, COUNTS, PLAN, SAMPLED) + (
        f"SELECT post_id, posts, type, order_key FROM sampled WHERE variant = '{_v}'")

ORACLE["train_eval_split"] = with_(*DATASET) + (
    "SELECT post_id, type, split_key, split FROM split WHERE variant = 'raw'")

ORACLE["split_sizes"] = with_(*DATASET) + (
    "SELECT variant, split, count(*) AS n FROM split GROUP BY variant, split")


# --- loading and text ------------------------------------------------------

def _first_words(col: str, n: int) -> str:
    return f"array_to_string(list_slice(string_split({col}, ' '), 1, {n}), ' ')"


FAULTY = """faulty AS (
  SELECT post_id,
         CASE WHEN post_id % 50 = 21 THEN NULL ELSE posts END AS posts,
         CASE WHEN post_id % 50 = 7 THEN 'XXXX' WHEN post_id % 50 = 13 THEN lower(type)
              ELSE type END AS type
  FROM posts)"""
LABELLED = """labelled AS (
  SELECT f.post_id, f.posts, upper(trim(f.type)) AS type, c.idx AS target,
         CASE WHEN f.posts IS NULL THEN 'null_post'
              WHEN c.idx IS NULL THEN 'unknown_type' END AS reason
  FROM faulty f LEFT JOIN classes c ON upper(c.name) = upper(trim(f.type)))"""
ORACLE["load_posts"] = with_(*BASE, FAULTY, LABELLED) + (
    "SELECT post_id, posts, type, target FROM labelled WHERE reason IS NULL")
ORACLE["rejects"] = with_(*BASE, FAULTY, LABELLED) + (
    "SELECT post_id, posts, type, reason FROM labelled WHERE reason IS NOT NULL")

RAW_SPLIT = """rsplit AS (
  SELECT post_id, posts, type, split_key,
         CASE WHEN rn <= floor(n * CAST(0.9 AS DOUBLE)) THEN 'train' ELSE 'eval' END AS split
  FROM (SELECT *, md5(CAST(post_id AS VARCHAR) || ':split:2') AS split_key,
               row_number() OVER (ORDER BY md5(CAST(post_id AS VARCHAR) || ':split:2'), post_id) AS rn,
               count(*) OVER () AS n
        FROM posts))"""
ORACLE["label_encode"] = with_(*BASE, RAW_SPLIT) + """
SELECT s.post_id, s.split, lower(s.type) AS mbti, c.idx AS target,
       CASE WHEN s.split = 'eval' THEN lower(s.type) END AS gold
FROM rsplit s LEFT JOIN classes c ON upper(c.name) = upper(trim(s.type))"""

for _n in (502, 256, 300):
    ORACLE[f"truncate_words_{_n}"] = with_(*BASE) + (
        f"SELECT post_id, {_first_words('posts', _n)} AS words FROM posts")


def _prompt(col: str, n: int, indent: int) -> str:
    return (f"{_sql_str(dims.instruction(indent))} || {_first_words(col, n)} || "
            f"{_sql_str(chr(10) + dims.ANSWER_MARK + chr(10))}")


ORACLE["prompt_build"] = with_(*BASE) + (
    f"SELECT post_id, {_prompt('posts', 256, 12)} AS prompt FROM posts")
ORACLE["generation_examples"] = with_(*BASE, RAW_SPLIT) + f"""
SELECT post_id, split,
       CASE WHEN split = 'train' THEN {_prompt('posts', 300, 8)} || lower(type)
            ELSE {_prompt('posts', 300, 8)} END AS example
FROM rsplit"""
ORACLE["preview"] = with_(*BASE, RAW_SPLIT) + f"""
SELECT post_id, {_first_words('posts', 502)} AS model_input, lower(type) AS mbti
FROM rsplit WHERE split = 'train' ORDER BY split_key, post_id LIMIT 1"""
ORACLE["basic_tokens"] = r"""
SELECT lower(t) AS token, count(*) AS n
FROM (SELECT unnest(regexp_extract_all(text, '\w+|\S')) AS t FROM documents)
GROUP BY lower(t)"""

# --- scores ------------------------------------------------------------------

SCORES = """z AS (
  SELECT p.post_id, lower(p.type) AS gold, c.idx, c.name,
         CAST((p.post_id * (31 + 17 * c.idx) + 7 * c.idx * c.idx) % 101 AS DOUBLE) / 10 AS z
  FROM posts p CROSS JOIN classes c),
zm AS (SELECT *, exp(z - max(z) OVER (PARTITION BY post_id)) AS e FROM z),
sm AS (SELECT post_id, gold, idx, name, z, e / sum(e) OVER (PARTITION BY post_id) AS p FROM zm),
ranked AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY z DESC, idx) AS rk FROM sm),
preds AS (
  SELECT r.post_id, r.gold, r.idx AS answer_idx, r.name AS answer, r.p AS confidence,
         g.rk AS gold_rank
  FROM ranked r JOIN ranked g ON g.post_id = r.post_id AND g.name = r.gold
  WHERE r.rk = 1)"""


def _matches(a: str, g: str) -> str:
    s = " + ".join(f"CAST(substr({a}, {i}, 1) = substr({g}, {i}, 1) AS INTEGER)" for i in (1, 2, 3, 4))
    return f"CASE WHEN length({a}) = length({g}) THEN {s} END"


def _pct(cond: str) -> str:
    return f"round(count_if({cond}) / count(*) * 100, 6)"


def _cls_metrics(a: str, g: str, hits: bool) -> str:
    m = _matches(a, g)
    cols = [f"count(*) AS n", f"CAST(count_if({a} = {g}) AS BIGINT) AS correct",
            f"{_pct(f'{a} = {g}')} AS accuracy",
            f"round(sum(coalesce(CAST({m} AS DOUBLE) / 4, CAST(0 AS DOUBLE))) / count(*) * 100, 6)"
            f" AS mean_match"]
    for i in range(4):
        cols.append(f"{_pct(f'length({a}) = length({g}) AND substr({a}, {i+1}, 1) = substr({g}, {i+1}, 1)')}"
                    f" AS letter_{i}")
    if hits:
        cols += [f"{_pct(f'gold_rank <= {k}')} AS hit_{k}" for k in (3, 5, 10)]
    return ", ".join(cols)


SC = BASE + [SCORES]
ORACLE["softmax"] = with_(*SC) + "SELECT post_id, idx, round(p, 9) AS p FROM sm"
ORACLE["class_ranking"] = with_(*SC) + "SELECT post_id, rk, name FROM ranked"
ORACLE["predictions"] = with_(*SC) + (
    "SELECT post_id, gold, answer_idx, answer, round(confidence, 9) AS confidence, gold_rank "
    "FROM preds")
ORACLE["top5"] = with_(*SC) + "SELECT post_id, rk, name, round(p, 9) AS p FROM ranked WHERE rk <= 5"
ORACLE["top10_string"] = with_(*SC) + (
    "SELECT post_id, string_agg(name, ' ' ORDER BY rk) AS top10 FROM ranked WHERE rk <= 10 "
    "GROUP BY post_id")
ORACLE["hit_at_k"] = with_(*SC) + (
    "SELECT count(*) AS n, " + ", ".join(f"{_pct(f'gold_rank <= {k}')} AS hit_{k}" for k in (3, 5, 10))
    + " FROM preds")
ORACLE["metrics_16way"] = with_(*SC) + f"SELECT {_cls_metrics('answer', 'gold', True)} FROM preds"
ORACLE["match_histogram"] = with_(*SC) + f"""
SELECT k.k, CAST(count_if(m.m = k.k) AS BIGINT) AS exactly_k_correct,
       round(count_if(m.m = k.k) / max(t.n) * 100, 6) AS rate
FROM (VALUES (0), (1), (2), (3), (4)) k(k)
CROSS JOIN (SELECT {_matches('answer', 'gold')} AS m FROM preds) m
CROSS JOIN (SELECT count(*) AS n FROM preds) t
GROUP BY k.k"""
ORACLE["ce_double_softmax"] = with_(*SC) + """
SELECT count(*) AS n, round(avg(ce), 9) AS ce FROM (
  SELECT post_id, ln(sum(exp(p))) - max(CASE WHEN name = gold THEN p END) AS ce
  FROM sm GROUP BY post_id)"""
ORACLE["ce_plain"] = with_(*SC) + """
SELECT count(*) AS n, round(avg(-ln(p)), 9) AS ce FROM sm WHERE name = gold"""

AXES = """ax AS (
  SELECT p.post_id, lower(p.type) AS gold, a.i,
         CAST((p.post_id * (13 + 5 * a.i) + 3 * a.i) % 97 AS DOUBLE) / 96 AS p1
  FROM posts p CROSS JOIN (VALUES (0), (1), (2), (3)) a(i)),
comp AS (
  SELECT post_id, gold, CAST(sum(CASE WHEN p1 > 1 - p1 THEN 1 ELSE 0 END * CAST(pow(2, 3 - i) AS INTEGER)) AS INTEGER) AS answer_idx
  FROM ax GROUP BY post_id, gold),
composed AS (
  SELECT comp.post_id, comp.gold, comp.answer_idx, c.name AS answer,
         lpad(bin(comp.answer_idx), 4, '0') AS bits
  FROM comp JOIN classes c ON c.idx = comp.answer_idx)"""
AX = BASE + [AXES]
ORACLE["axis_bits"] = with_(*BASE) + """
SELECT p.post_id, c.idx AS target, lpad(bin(c.idx), 4, '0') AS bits, c.idx AS idx_back
FROM posts p JOIN classes c ON upper(c.name) = p.type"""
ORACLE["axis_compose"] = with_(*AX) + "SELECT post_id, gold, bits, answer_idx, answer FROM composed"
ORACLE["metrics_axes"] = with_(*AX) + f"SELECT {_cls_metrics('answer', 'gold', False)} FROM composed"
ORACLE["ce_axes"] = with_(*AX) + """
SELECT count(*) AS n, round(avg(ln(exp(1 - ax.p1) + exp(ax.p1))
       - CASE WHEN (c.idx >> (3 - ax.i)) & 1 = 1 THEN ax.p1 ELSE 1 - ax.p1 END), 9) AS ce
FROM ax JOIN classes c ON c.name = ax.gold"""
ORACLE["linear_head"] = """
WITH w AS (
  SELECT c.idx, j.j, CAST(((c.idx * 13 + j.j * 7) % 11) - 5 AS DOUBLE) / 10 AS w
  FROM range(16) c(idx) CROSS JOIN range(64) j(j)),
e AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(64)) AS j FROM embeddings),
lg AS (SELECT e.vec_id, w.idx, sum(CAST(e.x AS DOUBLE) * w.w) AS logit
       FROM e JOIN w ON w.j = e.j GROUP BY e.vec_id, w.idx),
ex AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS ex FROM lg)
SELECT vec_id, CAST(idx AS INTEGER) AS idx, round(logit, 6) AS logit,
       round(ex / sum(ex) OVER (PARTITION BY vec_id), 9) AS p FROM ex"""

# --- generation output -------------------------------------------------------

_HEAD = _prompt("p.posts", 300, 8)
GENS = f"""gens AS (
  SELECT p.post_id, lower(p.type) AS gold,
         CASE p.post_id % 4
           WHEN 0 THEN {_HEAD} || a.name || '<|endoftext|>'
           WHEN 1 THEN {_HEAD} || a.name
           WHEN 2 THEN {_HEAD} || a.name || ' <|endoftext|>'
           ELSE '[Text]' || chr(10) || p.posts || chr(10) || a.name || '<|endoftext|>' END AS g,
         CASE WHEN p.post_id % 5 = 0 THEN substr(nv.name, 1, 2) ELSE nv.name END AS naive
  FROM posts p
  JOIN classes a ON a.idx = (p.post_id * 5 + 3) % 16
  JOIN classes nv ON nv.idx = (p.post_id * 11) % 16),
parsed AS (
  SELECT *, CASE WHEN contains(g, '[MBTI]') AND contains(g, '<|endoftext|>') THEN
              split_part(regexp_replace(string_split(g, '[MBTI]')[-1], '^\\s+|\\s+$', '', 'g'),
                         '<|endoftext|>', 1) END AS answer
  FROM gens)"""
GEN = BASE + [GENS]


def _gen_mm(a: str) -> str:
    m = _matches(a, "gold")
    return (f"round(sum(coalesce(CASE WHEN length({a}) = length(gold) THEN CAST({m} AS DOUBLE) "
            f"/ CAST(length(gold) AS DOUBLE) END, CAST(0 AS DOUBLE))) / count(*) * 100, 6)")


ORACLE["parse_generation"] = with_(*GEN) + "SELECT post_id, gold, answer FROM parsed"
ORACLE["metrics_generation"] = with_(*GEN) + f"""
SELECT count(*) AS n, {_pct('answer = gold')} AS accuracy, {_gen_mm('answer')} AS mean_match,
       {_pct('naive = gold')} AS naive_accuracy, {_gen_mm('naive')} AS naive_mean_match
FROM parsed"""
ORACLE["generation_log"] = with_(*GEN) + (
    "SELECT post_id, g || chr(10) || 'Gold Answer: ' || gold AS log FROM gens")

# --- vocabulary and wordpiece -------------------------------------------------

VOCAB = r"""tok AS (
  SELECT lower(unnest(regexp_extract_all(text, '\w+|\S'))) AS t FROM documents),
pwords AS (
  SELECT DISTINCT lower(unnest(regexp_extract_all(""" + _sql_str(dims.instruction(8)) + r""", '\w+|\S'))) AS t),
tcounts AS (SELECT t, count(*) AS n FROM tok GROUP BY t),
chars AS (SELECT DISTINCT piece FROM (SELECT unnest(string_split(t, '')) AS piece FROM (SELECT t FROM tcounts UNION ALL SELECT t FROM pwords))
          WHERE length(piece) = 1),
vwords AS (SELECT piece FROM (SELECT t AS piece FROM tcounts WHERE length(t) > 1 ORDER BY n DESC, t LIMIT 400)
  UNION SELECT t FROM pwords WHERE length(t) > 1),
vends AS (SELECT '##' || e AS piece FROM (
            SELECT right(t, 2) AS e, sum(n) AS n FROM tcounts WHERE length(t) > 2
            GROUP BY right(t, 2) ORDER BY n DESC, e LIMIT 60)),
allp AS (
  SELECT 0 AS kind, k, piece FROM (VALUES (0, '[PAD]'), (1, '[UNK]'), (2, '[CLS]'), (3, '[SEP]')) s(k, piece)
  UNION ALL SELECT 1, 0, piece FROM chars
  UNION ALL SELECT 2, 0, '##' || piece FROM chars
  UNION ALL SELECT 3, 0, piece FROM vwords
  UNION ALL SELECT 4, 0, piece FROM vends),
vocab AS (SELECT piece, CAST(row_number() OVER (ORDER BY kind, k, piece) - 1 AS INTEGER) AS id FROM allp)"""


def wordpiece_ctes(words_cte: str) -> str:
    """Greedy longest-match WordPiece of the words in ``words_cte(w)`` as a
    recursive CTE -> ``wp(w, ids INTEGER[], unk BOOLEAN)``."""
    return f"""wstart AS (SELECT w, unnest(range(0, length(w))) AS s FROM {words_cte}),
wcand AS (SELECT w, s, unnest(range(1, length(w) - s + 1)) AS l FROM wstart),
wbest AS (
  SELECT c.w, c.s, max(c.l) AS l, arg_max(v.id, c.l) AS id
  FROM wcand c JOIN vocab v
    ON v.piece = CASE WHEN c.s = 0 THEN substr(c.w, 1, c.l) ELSE '##' || substr(c.w, c.s + 1, c.l) END
  GROUP BY c.w, c.s),
chain(w, pos, ids) AS (
  SELECT w, 0, CAST([] AS INTEGER[]) FROM {words_cte}
  UNION ALL
  SELECT c.w, c.pos + b.l, list_append(c.ids, b.id)
  FROM chain c JOIN wbest b ON b.w = c.w AND b.s = c.pos
  WHERE c.pos < length(c.w)),
wdone AS (SELECT w, arg_max(ids, pos) AS ids, max(pos) AS pos FROM chain GROUP BY w),
wp AS (
  SELECT x.w,
         CASE WHEN d.pos = length(x.w) THEN d.ids ELSE [1] END AS ids,
         NOT coalesce(d.pos = length(x.w), false) AS unk
  FROM {words_cte} x LEFT JOIN wdone d ON d.w = x.w)"""


ORACLE["vocab_lookup"] = "WITH " + VOCAB + "\nSELECT piece, id FROM vocab"
ORACLE["wordpiece_ids"] = "WITH RECURSIVE " + VOCAB + r""",
wl AS (SELECT DISTINCT t AS w FROM tok),
""" + wordpiece_ctes("wl") + "\nSELECT w, array_to_string(ids, ' ') AS ids FROM wp"
ORACLE["encode_capped"] = ("WITH RECURSIVE " + ",\n".join([CLASSES, POSTS, VOCAB]) + r""",
ptok AS (
  SELECT post_id, unnest(tl) AS w, unnest(range(1, len(tl) + 1)) AS pos
  FROM (SELECT post_id, list_slice(list_transform(regexp_extract_all(posts, '\w+|\S'), lambda x: lower(x)), 1, 510) AS tl
        FROM posts)),
pl AS (SELECT DISTINCT w FROM ptok),
""" + wordpiece_ctes("pl") + r""",
enc AS (
  SELECT t.post_id, flatten(list(wp.ids ORDER BY t.pos)) AS ids
  FROM ptok t JOIN wp ON wp.w = t.w GROUP BY t.post_id),
capped AS (
  SELECT p.post_id, list_concat([2], list_slice(coalesce(e.ids, CAST([] AS INTEGER[])), 1, 510), [3]) AS ids
  FROM posts p LEFT JOIN enc e ON e.post_id = p.post_id)
SELECT post_id, CAST(len(ids) AS INTEGER) AS n_ids, array_to_string(ids, ' ') AS ids FROM capped""")
ORACLE["unk_rate"] = "WITH RECURSIVE " + VOCAB + r""",
dtok AS (SELECT lang, lower(unnest(regexp_extract_all(text, '\w+|\S'))) AS w FROM documents),
dwc AS (SELECT lang, w, count(*) AS n FROM dtok GROUP BY lang, w),
dl AS (SELECT DISTINCT w FROM dwc),
""" + wordpiece_ctes("dl") + """
SELECT c.lang, CAST(sum(c.n) AS BIGINT) AS n_words,
       CAST(sum(CASE WHEN wp.unk THEN c.n ELSE 0 END) AS BIGINT) AS n_unk,
       CAST(sum(c.n * len(wp.ids)) AS BIGINT) AS n_ids,
       round(sum(CASE WHEN wp.unk THEN c.n ELSE 0 END) / sum(c.n), 9) AS unk_rate
FROM dwc c JOIN wp ON wp.w = c.w GROUP BY c.lang"""

# --- variants on disk, batches, epochs, sessions ----------------------------------

ORACLE["variant_slice"] = with_(*DATASET) + (
    "SELECT post_id, posts, type FROM split WHERE variant = 'bal' AND split = 'train'")
_REDRAWN = [x.replace("sampled AS", "sampled7 AS").replace(":2'", ":7'").replace("('bal'), ('prop')", "('bal')") for x in [SAMPLED]] + [
    SPLIT.replace("split AS (", "split7 AS (", 1).replace("FROM variants", "FROM sampled7").replace(":split:2", ":split:7")]
ORACLE["variant_redrawn"] = with_(*DATASET, *_REDRAWN) + """
SELECT variant, split, count(*) AS n, CAST(sum(post_id) AS BIGINT) AS ids, CAST(sum(length(posts)) AS BIGINT) AS chars
FROM (SELECT variant, split, post_id, posts FROM split WHERE variant != 'bal'
      UNION ALL SELECT variant, split, post_id, posts FROM split7) GROUP BY variant, split"""
ORACLE["split_anti"] = with_(*BASE, RAW_SPLIT) + "SELECT post_id, type FROM rsplit WHERE split = 'eval'"

_VSC = """vz AS (
  SELECT s.variant, s.post_id, lower(s.type) AS gold, c.idx, c.name,
         CAST((s.post_id * (31 + 17 * c.idx) + 7 * c.idx * c.idx) % 101 AS DOUBLE) / 10 AS z
  FROM split s CROSS JOIN classes c WHERE s.split = 'eval'),
vr AS (SELECT *, row_number() OVER (PARTITION BY variant, post_id ORDER BY z DESC, idx) AS rk FROM vz),
vpred AS (
  SELECT r.variant, r.gold, r.name AS answer, g.rk AS gold_rank
  FROM vr r JOIN vr g ON g.variant = r.variant AND g.post_id = r.post_id AND g.name = r.gold
  WHERE r.rk = 1),
vax AS (
  SELECT s.variant, s.post_id, lower(s.type) AS gold,
         CAST(sum(CASE WHEN CAST((s.post_id * (13 + 5 * a.i) + 3 * a.i) % 97 AS DOUBLE) / 96
                       > 1 - CAST((s.post_id * (13 + 5 * a.i) + 3 * a.i) % 97 AS DOUBLE) / 96
                  THEN 1 ELSE 0 END * CAST(pow(2, 3 - a.i) AS INTEGER)) AS INTEGER) AS idx
  FROM split s CROSS JOIN (VALUES (0), (1), (2), (3)) a(i) WHERE s.split = 'eval'
  GROUP BY s.variant, s.post_id, s.type),
vcomp AS (SELECT x.variant, x.gold, c.name AS answer FROM vax x JOIN classes c ON c.idx = x.idx)"""
ORACLE["metrics_by_variant"] = with_(*DATASET, _VSC) + f"""
SELECT variant, '16way' AS task, {_cls_metrics('answer', 'gold', True)} FROM vpred GROUP BY variant
UNION ALL
SELECT variant, 'axes' AS task, {_cls_metrics('answer', 'gold', False)},
       CAST(NULL AS DOUBLE) AS hit_3, CAST(NULL AS DOUBLE) AS hit_5, CAST(NULL AS DOUBLE) AS hit_10
FROM vcomp GROUP BY variant"""

RAW_RANK = """rr AS (
  SELECT post_id, posts, type, rn, floor(floor(n * CAST(0.9 AS DOUBLE)) / 64) * 64 AS full_rows
  FROM (SELECT *, row_number() OVER (ORDER BY md5(CAST(post_id AS VARCHAR) || ':split:2'), post_id) AS rn,
               count(*) OVER () AS n FROM posts)),
bt AS (SELECT post_id, posts, type, CAST((rn - 1) // 64 AS BIGINT) AS batch_id,
              CAST((rn - 1) % 64 AS INTEGER) AS pos
       FROM rr WHERE rn <= full_rows)"""
ORACLE["batches"] = with_(*BASE, RAW_RANK) + "SELECT post_id, batch_id, pos FROM bt"
# token rows: ids of the instruction, of the post's words with the answer mark, and of the class name
_LOWER_TOKENS = r"list_transform(regexp_extract_all({}, '\w+|\S'), lambda x: lower(x))"
_BODY = _first_words("posts", 300) + " || " + _sql_str("\n" + dims.ANSWER_MARK + "\n")
TOKROWS = ",\n".join([VOCAB, f"""texts AS (
  SELECT -1 AS k, {_LOWER_TOKENS.format(_sql_str(dims.instruction(8)))} AS tl
  UNION ALL SELECT post_id, list_slice({_LOWER_TOKENS.format(_BODY)}, 1, 512) FROM posts
  UNION ALL SELECT -2 - idx, [name] FROM classes),
ttok AS (SELECT k, unnest(tl) AS w, unnest(range(1, len(tl) + 1)) AS pos FROM texts),
twords AS (SELECT DISTINCT w FROM ttok)""", wordpiece_ctes("twords"), """tenc AS (
  SELECT t.k, flatten(list(wp.ids ORDER BY t.pos)) AS ids FROM ttok t JOIN wp ON wp.w = t.w GROUP BY t.k),
tr AS (
  SELECT p.post_id, list_concat(i.ids, b.ids) AS pids, n.ids AS tids
  FROM posts p JOIN tenc b ON b.k = p.post_id JOIN tenc i ON i.k = -1
  JOIN classes c ON upper(c.name) = p.type JOIN tenc n ON n.k = -2 - c.idx),
tin AS (SELECT post_id, len(pids) AS plen,
               list_transform(list_slice(list_concat(pids, tids), 1, 512), lambda x: CAST(x AS BIGINT)) AS ids
        FROM tr),
tl AS (SELECT post_id, ids, list_transform(ids, lambda x, i: CASE WHEN i <= plen THEN CAST(-100 AS BIGINT) ELSE x END) AS labels
       FROM tin)"""])


def _recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


_PADDED = """,
pb AS (SELECT bt.post_id, bt.batch_id, bt.pos, tl.ids, tl.labels, max(len(tl.ids)) OVER (PARTITION BY bt.batch_id) AS mx
       FROM bt JOIN tl ON tl.post_id = bt.post_id),
pd AS (SELECT post_id, batch_id, pos, labels,
              list_transform(range(mx - len(ids)), lambda x: CAST(0 AS BIGINT)) AS fill, ids
       FROM pb)
"""
ORACLE["padded_batches"] = _recursive(*BASE, RAW_RANK, TOKROWS).rstrip() + _PADDED + """
SELECT post_id, batch_id, array_to_string(list_concat(ids, fill), ' ') AS ids,
       array_to_string(list_transform(list_concat(ids, fill), lambda x: x != 0), ' ') AS mask FROM pd"""
ORACLE["collated_batches"] = _recursive(*BASE, RAW_RANK, TOKROWS).rstrip() + _PADDED + """
SELECT post_id, batch_id, pos, array_to_string(list_concat(ids, fill), ' ') AS ids,
       array_to_string(list_concat(labels, fill), ' ') AS labels,
       array_to_string(list_transform(list_concat(ids, fill), lambda x: x != 0), ' ') AS mask FROM pd"""
ORACLE["token_labels"] = _recursive(*BASE, TOKROWS) + """
SELECT post_id, array_to_string(labels, ' ') AS labels,
       CAST(len(list_filter(ids, lambda x: x != 0)) AS INTEGER) AS n_nonpad,
       array_to_string(labels[2:], ' ') AS shifted,
       CAST(len(list_filter(labels, lambda x: x != -100)) AS INTEGER) AS n_supervised
FROM tl"""
EPOCH = """ez AS (
  SELECT bt.post_id, bt.batch_id, e.epoch, c.idx, lower(bt.type) = c.name AS is_gold,
         CAST((bt.post_id * (31 + 17 * c.idx) + 7 * c.idx * c.idx) % 101 AS DOUBLE) / 10
           + CASE WHEN lower(bt.type) = c.name THEN CAST(e.epoch AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS z
  FROM bt CROSS JOIN classes c CROSS JOIN (VALUES (1), (2), (3)) e(epoch)),
em AS (SELECT *, exp(z - max(z) OVER (PARTITION BY post_id, epoch)) AS ex FROM ez),
ep AS (SELECT *, ex / sum(ex) OVER (PARTITION BY post_id, epoch) AS p FROM em),
rowloss AS (SELECT epoch, batch_id, post_id,
                   ln(sum(exp(p))) - max(CASE WHEN is_gold THEN p END) AS ce
            FROM ep GROUP BY epoch, batch_id, post_id),
bl AS (SELECT epoch, batch_id, avg(ce) AS loss FROM rowloss GROUP BY epoch, batch_id),
el AS (SELECT epoch, round(avg(loss), 9) AS loss, round(exp(avg(loss)), 9) AS perplexity
       FROM bl GROUP BY epoch)"""
ORACLE["epoch_perplexity"] = with_(*BASE, RAW_RANK, EPOCH) + "SELECT epoch, loss, perplexity FROM el"
ORACLE["run_summary"] = with_(*BASE, RAW_RANK, EPOCH) + """
SELECT round(avg(perplexity), 9) AS avg_train_prep, round(avg(loss), 9) AS avg_train_loss,
       count(*) AS epochs,
       (SELECT round(avg(n * CAST(0.25 AS DOUBLE)), 9) FROM (SELECT count(*) AS n FROM bl GROUP BY epoch)) AS avg_epoch_time,
       round(avg(epoch * CAST(0.125 AS DOUBLE)), 9) AS avg_checkpoint_time
FROM el"""
ORACLE["running_transcript"] = """
SELECT conv_id AS session_id, turn,
       array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS transcript
FROM conversations"""
ORACLE["marker_sessions"] = """
SELECT user_id, event_id,
       CAST(coalesce(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END)
            OVER (PARTITION BY user_id ORDER BY ts, event_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS session_no
FROM events"""
ORACLE["stream_transcript"] = ORACLE["running_transcript"]
# --- fits that SQL can follow, faults, streams --------------------------------------

ORACLE["resample_faulty"] = with_(*BASE, FAULTY, LABELLED) .rstrip() + r""",
fposts AS (SELECT post_id, posts, type FROM labelled WHERE reason IS NULL),
fc AS (SELECT c.type, c.n, p.real_frac FROM (SELECT type, count(*) AS n FROM fposts GROUP BY type) c
       JOIN priors p ON p.type = c.type AND p.variant = 'prop'),
fplan AS (SELECT type, floor(real_frac * (SELECT floor(min(n / real_frac)) FROM fc)) AS cut FROM fc),
fr AS (SELECT *, md5(CAST(post_id AS VARCHAR) || ':2') AS order_key,
              row_number() OVER (PARTITION BY type ORDER BY md5(CAST(post_id AS VARCHAR) || ':2'), post_id) AS rn FROM fposts)
SELECT post_id, posts, fr.type, order_key FROM fr JOIN fplan ON fplan.type = fr.type WHERE rn <= cut"""

ORACLE["resample_both"] = with_(*BASE, COUNTS, PLAN, SAMPLED).rstrip() + r""",
first AS (SELECT post_id, posts, type, order_key FROM sampled WHERE variant = 'prop'),
bc AS (SELECT c.type, c.n, p.real_frac FROM (SELECT type, count(*) AS n FROM first GROUP BY type) c
       JOIN priors p ON p.type = c.type AND p.variant = 'bal'),
bplan AS (SELECT type, floor(real_frac * (SELECT floor(min(n / real_frac)) FROM bc)) AS cut FROM bc),
br AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY order_key, post_id) AS rn FROM first)
SELECT 'prop' AS variant, post_id, posts, br.type FROM br JOIN bplan ON bplan.type = br.type WHERE rn <= cut"""

ORACLE["device_tokens"] = "WITH RECURSIVE " + VOCAB + r""",
dv AS (SELECT piece, id FROM vocab WHERE length(regexp_replace(piece, '^##', '')) > 1),
dt AS (SELECT source, lower(unnest(regexp_extract_all(text, '\w+|\S'))) AS w FROM documents),
dc AS (SELECT source, w, count(*) AS n FROM dt GROUP BY source, w),
dw AS (SELECT DISTINCT w FROM dc),
cuts AS (SELECT w, unnest(range(1, length(w))) AS c FROM dw WHERE w NOT IN (SELECT piece FROM dv)),
heads AS (SELECT c.w, c.c FROM cuts c JOIN dv ON dv.piece = substr(c.w, 1, c.c)),
follow(w, c, rest, spare, k) AS (
  SELECT w, c, substr(w, c + 1), CAST(0 AS BIGINT), CAST(1 AS BIGINT) FROM heads
  UNION ALL
  SELECT f.w, f.c, CASE WHEN v.id IS NULL THEN f.rest ELSE right(f.rest, CAST(f.spare AS INTEGER)) END,
         CASE WHEN v.id IS NULL THEN f.spare + 1 ELSE 1 END, CASE WHEN v.id IS NULL THEN f.k ELSE f.k + 1 END
  FROM follow f LEFT JOIN dv v ON v.piece = '##' || substr(f.rest, 1, length(f.rest) - f.spare)
  WHERE f.spare < length(f.rest)),
per_head AS (SELECT w, c, max(k) AS k FROM follow GROUP BY w, c),
per_word AS (
  SELECT w, sum(k) AS k FROM per_head GROUP BY w
  UNION ALL SELECT w, 1 FROM dw WHERE w IN (SELECT piece FROM dv))
SELECT source, CAST(sum(n) AS BIGINT) AS n_words, CAST(sum(n * coalesce(k, 0)) AS BIGINT) AS n_ids,
       CAST(sum(CASE WHEN coalesce(k, 0) = 0 THEN n ELSE 0 END) AS BIGINT) AS tokens_dropped
FROM dc LEFT JOIN per_word USING (w) GROUP BY source"""


def _count_model(data: str, n_classes: int, label: str, name: str) -> str:
    """CTEs of the closed-form fit on ``data(part, split, post_id, input, ...)``
    -> ``<name>(part, post_id, c, z)``; ``part`` tells datasets apart."""
    return rf"""{name}_tok AS (
  SELECT part, split, post_id, {label} AS c, lower(unnest(regexp_extract_all(input, '\w+|\S'))) AS w FROM {data}),
{name}_n AS (SELECT part, c, w, count(*) AS n FROM {name}_tok WHERE split = 'train' GROUP BY part, c, w),
{name}_v AS (SELECT part, count(DISTINCT w) AS v FROM {name}_n GROUP BY part),
{name}_c AS (SELECT v.part, r.c, v.v + coalesce(t.n, 0) AS total,
                    ln((coalesce(d.n, 0) + 1) / (s.n + {n_classes})) AS prior
             FROM {name}_v v CROSS JOIN range({n_classes}) r(c)
             LEFT JOIN (SELECT part, c, sum(n) AS n FROM {name}_n GROUP BY part, c) t ON t.part = v.part AND t.c = r.c
             LEFT JOIN (SELECT part, {label} AS c, count(*) AS n FROM {data} WHERE split = 'train' GROUP BY ALL) d
               ON d.part = v.part AND d.c = r.c
             JOIN (SELECT part, count(*) AS n FROM {data} WHERE split = 'train' GROUP BY part) s ON s.part = v.part),
{name}_e AS (SELECT e.part, e.post_id, e.w, count(*) AS n FROM {name}_tok e
             JOIN (SELECT DISTINCT part, w FROM {name}_n) k ON k.part = e.part AND k.w = e.w
             WHERE e.split = 'eval' GROUP BY ALL),
{name} AS (
  SELECT p.part, p.post_id, c.c, any_value(c.prior) + coalesce(sum(e.n * ln((coalesce(n.n, 0) + 1) / CAST(c.total AS DOUBLE))), 0) AS z
  FROM (SELECT part, post_id FROM {data} WHERE split = 'eval') p JOIN {name}_c c ON c.part = p.part
  LEFT JOIN {name}_e e ON e.part = p.part AND e.post_id = p.post_id
  LEFT JOIN {name}_n n ON n.part = p.part AND n.c = c.c AND n.w = e.w
  GROUP BY p.part, p.post_id, c.c)"""


_DATA16 = f"""data AS (
  SELECT s.variant AS part, s.split, s.post_id, {_first_words('s.posts', 502)} AS input, c.idx, lower(s.type) AS gold
  FROM split s JOIN classes c ON upper(c.name) = s.type)"""
_RAW16 = _DATA16.replace("c ON upper(c.name) = s.type)", "c ON upper(c.name) = s.type WHERE s.variant = 'raw')")
_RANK16 = """cr AS (SELECT m.part, m.post_id, c.name, m.z,
               row_number() OVER (PARTITION BY m.part, m.post_id ORDER BY m.z DESC, m.c) AS rk
        FROM m JOIN classes c ON c.idx = m.c),
cp AS (SELECT d.part, d.post_id, d.gold, a.name AS answer, g.rk AS gold_rank, a.z
       FROM data d JOIN cr a ON a.part = d.part AND a.post_id = d.post_id AND a.rk = 1
       JOIN cr g ON g.part = d.part AND g.post_id = d.post_id AND g.name = d.gold WHERE d.split = 'eval')"""
_AXIS = ",\n".join(_count_model("data", 2, f"((idx >> {3 - i}) & 1)", f"m{i}") for i in range(4))
_AXES = """bits AS (
  SELECT part, post_id, i, CASE WHEN max(CASE WHEN c = 1 THEN z END) > max(CASE WHEN c = 0 THEN z END) THEN 1 ELSE 0 END AS bit
  FROM (""" + " UNION ALL ".join(f"SELECT {i} AS i, * FROM m{i}" for i in range(4)) + """) GROUP BY part, post_id, i),
ca AS (SELECT b.part, b.post_id, CAST(sum(bit * CAST(pow(2, 3 - i) AS INTEGER)) AS INTEGER) AS idx
       FROM bits b GROUP BY b.part, b.post_id),
cx AS (SELECT a.part, a.post_id, d.gold, lpad(bin(a.idx), 4, '0') AS bits, c.name AS answer
       FROM ca a JOIN classes c ON c.idx = a.idx JOIN data d ON d.part = a.part AND d.post_id = a.post_id)"""
ORACLE["count_score_16way"] = with_(*DATASET, _RAW16, _count_model("data", 16, "idx", "m"), _RANK16) + (
    "SELECT post_id, gold, answer, gold_rank, round(z, 5) AS z FROM cp")
ORACLE["count_score_axes"] = with_(*DATASET, _RAW16, _AXIS, _AXES) + "SELECT post_id, gold, bits, answer FROM cx"
_FEW = _cls_metrics("answer", "gold", False).split(", round(count_if(length")[0]
ORACLE["count_metrics_by_variant"] = with_(*DATASET, _DATA16, _count_model("data", 16, "idx", "m"), _RANK16, _AXIS, _AXES) + f"""
SELECT part AS variant, '16way' AS task, {_FEW} FROM cp GROUP BY part
UNION ALL SELECT part, 'axes', {_FEW} FROM cx GROUP BY part"""

_TOKENS_OF = r"len(regexp_extract_all({}, '\w+|\S'))"
ORACLE["stream_stop"] = rf"""
WITH s AS (SELECT *, sum(CASE WHEN turn % 3 = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM conversations),
t AS (SELECT conv_id AS session_id, turn,
             array_to_string(list(text) OVER (PARTITION BY conv_id, part ORDER BY turn
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS transcript
      FROM s WHERE turn % 3 != 2)
SELECT session_id, turn, transcript, CAST({_TOKENS_OF.format('transcript')} AS BIGINT) AS n_tokens FROM t"""
_CAPPED = rf"""
WITH r AS ({ORACLE["running_transcript"]}),
c AS (SELECT session_id, turn, CASE WHEN {_TOKENS_OF.format('transcript')} >= 20
             THEN regexp_extract(transcript, '^(?:\s*(?:\w+|\S)){{20}}') ELSE transcript END AS transcript FROM r)
"""
ORACLE["running_transcript_capped"] = _CAPPED + "SELECT session_id, turn, transcript FROM c"
ORACLE["stream_capped"] = _CAPPED + (
    f"SELECT session_id, turn, transcript, CAST({_TOKENS_OF.format('transcript')} AS BIGINT) AS n_tokens FROM c")
_BUCKET = "CAST('0x' || substr(md5({}), 1, 3) AS INTEGER)"
ORACLE["stream_top5"] = with_(*DATASET, _RAW16, rf"""tb AS (
  SELECT {_BUCKET.format('w')} AS b, idx AS c, count(*) AS n FROM (
    SELECT idx, unnest({_LOWER_TOKENS.format('input')}) AS w FROM data WHERE split = 'train') GROUP BY ALL),
tn AS (SELECT c, sum(n) AS n FROM tb GROUP BY c),
td AS (SELECT idx AS c, count(*) AS n FROM data WHERE split = 'train' GROUP BY ALL),
cl AS (SELECT k.idx, k.name, coalesce(tn.n, 0) + 4096 AS total,
              floor(1000000 * ln((coalesce(td.n, 0) + 1) / CAST((SELECT sum(n) FROM td) + 16 AS DOUBLE))) AS prior
       FROM classes k LEFT JOIN tn ON tn.c = k.idx LEFT JOIN td ON td.c = k.idx),
r AS ({ORACLE['running_transcript']}),
rt AS (SELECT session_id, turn, unnest({_LOWER_TOKENS.format('transcript')}) AS w FROM r),
rb AS (SELECT session_id, turn, {_BUCKET.format('w')} AS b, count(*) AS n FROM rt GROUP BY ALL),
rz AS (SELECT rb.session_id, rb.turn, k.idx,
              sum(rb.n * floor(1000000 * ln((coalesce(tb.n, 0) + 1) / CAST(k.total AS DOUBLE)))) AS s, sum(rb.n) AS words
       FROM rb CROSS JOIN cl k LEFT JOIN tb ON tb.b = rb.b AND tb.c = k.idx GROUP BY ALL),
z AS (SELECT r.session_id, r.turn, k.idx, k.name, CAST(coalesce(rz.words, 0) AS BIGINT) AS n_tokens, (k.prior + coalesce(rz.s, 0)) / 1000000 AS z
      FROM r CROSS JOIN cl k LEFT JOIN rz ON rz.session_id = r.session_id AND rz.turn = r.turn AND rz.idx = k.idx),
e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY session_id, turn)) AS e FROM z),
k AS (SELECT session_id, turn, n_tokens, name, e / sum(e) OVER (PARTITION BY session_id, turn) AS p,
             row_number() OVER (PARTITION BY session_id, turn ORDER BY e DESC, idx) AS rk FROM e)""") + """
SELECT session_id, turn, n_tokens, rk, name, round(p, 9) AS p FROM k WHERE rk <= 5"""

ORACLE["csv_round_trip"] = with_(*BASE) + r"""
SELECT md5(CAST(row_number() OVER (PARTITION BY posts, type) AS VARCHAR) || '|+' || type || '|+' || posts) AS post_id, posts, type FROM posts"""


def _epoch_ctes(epochs: int = 2, steps: int = 2, rate: float = 0.05, gamma: float = 0.85) -> str:
    """Two epochs of training, every optimizer step spelled out: features f,
    batches of 64, and per step t the weights w<t> (class, feature)."""
    out = [f"""inputs AS (SELECT post_id, lower(type) AS gold, {_prompt('posts', 256, 12)} AS body FROM posts),
toks AS (SELECT post_id, unnest({_LOWER_TOKENS.format('body')}) AS w FROM inputs),
share AS (SELECT post_id, CAST('0x' || substr(md5(w), 1, 2) AS INTEGER) % 32 AS d, count(*) AS n FROM toks GROUP BY ALL),
f AS MATERIALIZED (
  SELECT post_id, d, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY post_id) AS x FROM share
  UNION ALL SELECT post_id, 32, CAST(1 AS DOUBLE) FROM posts),
tb AS MATERIALIZED (
  SELECT bt.post_id, bt.batch_id, c.idx AS y,
         CAST(floor(bt.batch_id / ceil((max(bt.batch_id) OVER () + 1) / CAST({steps} AS DOUBLE))) AS INTEGER) AS step,
         ceil((max(bt.batch_id) OVER () + 1) / CAST({steps} AS DOUBLE)) AS acc
  FROM bt JOIN classes c ON c.name = lower(bt.type)),
w0 AS (SELECT idx AS c, d, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS v
       FROM classes, range(33) r(d))"""]
    t = 0
    for epoch in range(epochs):
        for step in range(steps):
            t += 1
            out.append(f"""z{t} AS (SELECT tb.post_id, tb.y, tb.acc, w.c, sum(f.x * w.w) AS z
  FROM tb JOIN f USING (post_id) JOIN w{t - 1} w ON w.d = f.d WHERE tb.step = {step} GROUP BY ALL),
e{t} AS (SELECT *, exp(z - max(z) OVER (PARTITION BY post_id)) AS ex FROM z{t}),
p{t} AS (SELECT *, ex / sum(ex) OVER (PARTITION BY post_id) AS p FROM e{t}),
q{t} AS (SELECT *, exp(p) / sum(exp(p)) OVER (PARTITION BY post_id) - CASE WHEN c = y THEN 1 ELSE 0 END AS q FROM p{t}),
s{t} AS MATERIALIZED (SELECT *, p * (q - sum(q * p) OVER (PARTITION BY post_id)) AS s FROM q{t}),
l{t} AS MATERIALIZED (SELECT {epoch + 1} AS epoch, post_id, ln(sum(exp(p))) - max(CASE WHEN c = y THEN p END) AS loss FROM p{t} GROUP BY post_id),
g{t} AS (SELECT s.c, f.d, sum(s.s * f.x / (64 * s.acc)) AS g FROM s{t} s JOIN f USING (post_id) GROUP BY ALL),
a{t} AS (SELECT w.c, w.d, w.w, {BETAS[0]!r}::DOUBLE * w.m + (1 - {BETAS[0]!r}::DOUBLE) * coalesce(g, 0) AS m,
                {BETAS[1]!r}::DOUBLE * w.v + (1 - {BETAS[1]!r}::DOUBLE) * coalesce(g, 0) * coalesce(g, 0) AS v
         FROM w{t - 1} w LEFT JOIN g{t} USING (c, d)),
w{t} AS MATERIALIZED (SELECT c, d, w - {rate * gamma ** epoch!r}::DOUBLE * (m / {1 - BETAS[0] ** t!r}::DOUBLE)
                / (sqrt(v / {1 - BETAS[1] ** t!r}::DOUBLE) + {EPSILON!r}::DOUBLE) AS w, m, v FROM a{t})""")
    out.append("losses AS (" + " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(1, t + 1)) + ")")
    return ",\n".join(out)


ORACLE["train_log"] = with_(*BASE, RAW_RANK, _epoch_ctes()) + """
SELECT CAST(epoch AS INTEGER) AS epoch, round(avg(loss), 8) AS loss, round(exp(avg(loss)), 8) AS perplexity,
       CAST(2 AS BIGINT) AS steps, true AS timed
FROM losses GROUP BY epoch"""
ORACLE["epoch_score_16way"] = with_(*BASE, RAW_RANK, _epoch_ctes()) + """,
ez_ AS (SELECT i.post_id, i.gold, w.c, sum(f.x * w.w) AS z
        FROM rr JOIN inputs i USING (post_id) JOIN f USING (post_id) JOIN w4 w ON w.d = f.d
        WHERE rr.rn > floor((SELECT count(*) FROM posts) * CAST(0.9 AS DOUBLE)) GROUP BY ALL),
ep_ AS (SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY post_id) AS p,
               row_number() OVER (PARTITION BY post_id ORDER BY z DESC, c) AS k FROM ez_)
SELECT e.post_id, e.gold, max(CASE WHEN k = 1 THEN c.name END) AS answer,
       CAST(max(CASE WHEN c.name = e.gold THEN k END) AS BIGINT) AS gold_rank, round(max(p), 6) AS confidence
FROM ep_ e JOIN classes c ON c.idx = e.c GROUP BY e.post_id, e.gold"""


def _softmax_ctes(rows: str, steps: int = 3, rate: float = 4.0, penalty: float = 0.001) -> str:
    """Full-batch steps over features f(id, d, x), labels lab(id, h, y) and the
    classes hc(h, c) of the heads: weights w<t> and losses l<t> per step."""
    out = ["w0 AS (SELECT h, c, d, CAST(0 AS DOUBLE) AS w FROM hc CROSS JOIN (SELECT DISTINCT d FROM f))",
           f"tr AS MATERIALIZED (SELECT * FROM lab WHERE id IN ({rows}))",
           "hn AS (SELECT h, count(*) AS n FROM tr GROUP BY h)"]
    for t in range(1, steps + 1):
        out.append(f"""z{t} AS (SELECT tr.id, tr.h, tr.y, w.c, sum(f.x * w.w) AS z
  FROM tr JOIN f USING (id) JOIN w{t - 1} w ON w.d = f.d AND w.h = tr.h GROUP BY ALL),
e{t} AS (SELECT *, exp(z - max(z) OVER (PARTITION BY id, h)) AS ex FROM z{t}),
p{t} AS MATERIALIZED (SELECT id, h, c, y, ex / sum(ex) OVER (PARTITION BY id, h) AS p FROM e{t}),
l{t} AS (SELECT {t} AS step, h, count(*) AS n, avg(-ln(p)) AS loss FROM p{t} WHERE c = y GROUP BY h),
g{t} AS (SELECT p.h, p.c, f.d, sum((p.p - CASE WHEN p.c = p.y THEN 1 ELSE 0 END) * f.x) AS g FROM p{t} p JOIN f USING (id) GROUP BY ALL),
w{t} AS MATERIALIZED (SELECT w.h, w.c, w.d, w.w - {rate!r}::DOUBLE * (coalesce(g.g, 0) / hn.n + {penalty!r}::DOUBLE * w.w) AS w
  FROM w{t - 1} w JOIN hn USING (h) LEFT JOIN g{t} g USING (h, c, d))""")
    return ",\n".join(out)


_SHARES = rf"""toks AS (SELECT post_id, unnest({_LOWER_TOKENS.format('input')}) AS w FROM data),
share AS (SELECT post_id, CAST('0x' || substr(md5(w), 1, 2) AS INTEGER) % 32 AS d, count(*) AS n FROM toks GROUP BY ALL),
f AS MATERIALIZED (
  SELECT post_id AS id, d, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY post_id) AS x FROM share
  UNION ALL SELECT post_id, 32, CAST(1 AS DOUBLE) FROM data)"""
_TARGET = "SELECT {id} AS id, 'target' AS h, {idx} AS y FROM {t}"
_LETTERS = "SELECT {id} AS id, 'letter' || i AS h, ({idx} >> CAST(3 - i AS INTEGER)) & 1 AS y FROM {t} CROSS JOIN range(4) r(i)"
_HC16 = "SELECT 'target' AS h, c FROM range(16) r(c)"
_HC2 = "SELECT 'letter' || i AS h, c FROM range(4) a(i) CROSS JOIN range(2) b(c)"
_TRAIN = "SELECT post_id FROM data WHERE split = 'train'"
_SCORED = """sz AS (SELECT d.post_id, d.gold, w.h, w.c, sum(f.x * w.w) AS z
  FROM data d JOIN f ON f.id = d.post_id JOIN w3 w ON w.d = f.d WHERE d.split = 'eval' GROUP BY ALL),
sp AS (SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY post_id, h) AS p,
              row_number() OVER (PARTITION BY post_id, h ORDER BY z DESC, c) AS k FROM sz)"""
ORACLE["softmax_score_16way"] = with_(*DATASET, _RAW16, _SHARES, f"lab AS ({_TARGET.format(id='post_id', idx='idx', t='data')})",
                                      f"hc AS ({_HC16})", _softmax_ctes(_TRAIN), _SCORED) + """
SELECT s.post_id, s.gold, max(CASE WHEN k = 1 THEN c.name END) AS answer,
       CAST(max(CASE WHEN c.name = s.gold THEN k END) AS BIGINT) AS gold_rank, round(max(p), 6) AS confidence
FROM sp s JOIN classes c ON c.idx = s.c GROUP BY s.post_id, s.gold"""
ORACLE["softmax_score_axes"] = with_(*DATASET, _RAW16, _SHARES, f"lab AS ({_LETTERS.format(id='post_id', idx='idx', t='data')})",
                                     f"hc AS ({_HC2})", _softmax_ctes(_TRAIN), _SCORED, """
sx AS (SELECT post_id, gold, """ + ", ".join(f"max(CASE WHEN h = 'letter{i}' THEN p END) AS p{i}" for i in range(4)) + """
       FROM sp WHERE c = 1 GROUP BY post_id, gold),
sb AS (SELECT *, """ + " + ".join(f"CASE WHEN p{i} > 1 - p{i} THEN {8 >> i} ELSE 0 END" for i in range(4)) + """ AS idx FROM sx)""") + """
SELECT post_id, gold, lpad(bin(idx), 4, '0') AS bits, name AS answer, """ + ", ".join(f"round(p{i}, 6) AS p{i}" for i in range(4)) + """
FROM sb JOIN classes USING (idx)"""
_CLASS_OF = "CAST((CAST(vec_id * 7 + floor(vec_id / 5) AS BIGINT) % 23) % 16 AS INTEGER)"
ORACLE["softmax_head_log"] = with_(
    f"ev AS (SELECT vec_id, {_CLASS_OF} AS idx, embedding FROM embeddings WHERE embedding IS NOT NULL "
    "AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)",
    "f AS MATERIALIZED (SELECT vec_id AS id, unnest(range(64)) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM ev)",
    f"lab AS ({_TARGET.format(id='vec_id', idx='idx', t='ev')} UNION ALL {_LETTERS.format(id='vec_id', idx='idx', t='ev')})",
    f"hc AS ({_HC16} UNION ALL {_HC2})", _softmax_ctes("SELECT vec_id FROM ev")) + (
    "SELECT CAST(step AS INTEGER) AS step, h AS head, n, round(loss, 8) AS loss FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)")
