"""The SQL (DuckDB) that each registered query is compared with.

Written from the formulas, not from the Spark code: common table expressions are put together
from the fragments below.
"""

from __future__ import annotations

import hashlib

from civictopics.functions.stopwords import ENGLISH, PORTUGUESE
from civictopics.functions.text import WHITESPACE
from civictopics.operators.labelling import NO_CHILDREN, PROMPT
from civictopics.operators.spelling import ACCENTED, PLAIN
from civictopics.sources.taxonomy import subjects


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def with_(*parts: str, last: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + last


SPACE = text(WHITESPACE)
STOP = "(" + ", ".join(text(w) for w in ENGLISH) + ")"
STOP_PT = "(" + ", ".join(text(w) for w in PORTUGUESE) + ")"

# ------------------------------------------------------------------------- fragments


def simple(column: str) -> str:
    return (
        rf"list_filter(regexp_extract_all(lower({column}), '[\p{{L}}\p{{Nl}}\p{{No}}_]+'), "
        "lambda w: length(w) BETWEEN 2 AND 15 AND NOT starts_with(w, '_'))"
    )


def counted(column: str) -> str:
    spaced = f"translate({column}, E'\\n\\t', '  ')"
    filled = f"CASE WHEN {spaced} = '' THEN 'emptydoc' ELSE {spaced} END"
    return rf"regexp_extract_all(lower({filled}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def joined(column: str, sep: str = " ") -> str:
    return f"coalesce(array_to_string({column}, '{sep}'), '')"


def without_stop_words(column: str, stop: str = STOP) -> str:
    return f"list_filter({column}, lambda w: w NOT IN {stop})"


def prepared(table: str, text_col: str, id_col: str, name: str = "prepared") -> str:
    return f"""{name} AS (
  SELECT row_id, original_text, tokens, {joined('tokens')} AS clean_text FROM (
    SELECT row_id, original_text, {without_stop_words(simple('original_text'))} AS tokens FROM (
      SELECT min({id_col}) AS row_id, trim({text_col}, {SPACE}) AS original_text FROM {table}
      WHERE trim({text_col}, {SPACE}) <> '' GROUP BY 2)))"""


PREPARED = prepared("documents", "text", "doc_id")
TOKENS = PREPARED + f",\ntok AS (SELECT row_id, {counted('clean_text')} AS tokens FROM prepared)"
GIVEN = """given AS (
  SELECT doc_id AS row_id, lang, CAST(substr(source, 4) AS BIGINT) AS source, n_chars
  FROM documents)"""
WORDS_OF = "words_of AS (SELECT row_id, unnest(tokens) AS word FROM tok)"
VOCABULARY = """vocab AS (
  SELECT word, count(*) AS cf, count(DISTINCT row_id) AS df FROM words_of GROUP BY word)"""


def counts(column: str) -> str:
    return f"""{TOKENS},
{GIVEN},
{WORDS_OF},
counts AS (
  SELECT {column} AS topic, word, count(*) AS cnt
  FROM words_of JOIN given USING (row_id) GROUP BY 1, 2)"""


def tfidf(by: str = "", seeds: bool = False, source: str = "counts", name: str = "weights") -> str:
    """``by`` is empty or a list of columns followed by a comma."""
    group = f"PARTITION BY {by.rstrip(', ')}" if by else ""
    boost = "CASE WHEN word IN (SELECT word FROM seed_words) THEN 2 ELSE 1 END * " if seeds else ""
    return f"""{name} AS (
  SELECT {by}topic, word, cnt,
         CAST(cnt AS DOUBLE) / sum(cnt) OVER (PARTITION BY {by}topic) * {boost}
         ln(1 + mean_words / CAST(sum(cnt) OVER (PARTITION BY {by}word) AS DOUBLE)) AS weight
  FROM {source} JOIN (
    SELECT DISTINCT {by}topic, floor(avg(words) OVER ({group})) AS mean_words FROM (
      SELECT {by}topic, CAST(sum(cnt) AS DOUBLE) AS words FROM {source} GROUP BY {by}topic))
  USING ({by}topic))"""


def top(n: int = 10, by: str = "", source: str = "weights") -> str:
    return f"""top_words AS (
  SELECT * FROM (
    SELECT {by}topic, row_number() OVER (
             PARTITION BY {by}topic ORDER BY round(weight, 9) DESC, word) AS rank,
           word, round(weight, 9) AS weight
    FROM {source}) WHERE rank <= {n})"""


# Per topic NPMI of top_words over tok, for the columns of `by`.
def npmi(by: str = "") -> str:
    return f"""asked AS (SELECT DISTINCT word FROM top_words WHERE word IS NOT NULL),
placed AS (
  SELECT row_id, len(tokens) AS l, unnest(tokens) AS word, unnest(range(len(tokens))) AS p FROM tok),
hit AS (SELECT * FROM placed WHERE word IN (SELECT word FROM asked)),
seen AS (
  SELECT DISTINCT row_id, word, unnest(range(greatest(p - 9, 0), least(p, greatest(l - 10, 0)) + 1)) AS s
  FROM hit),
tot AS (SELECT sum(greatest(l - 9, 1)) AS n FROM (SELECT DISTINCT row_id, l FROM hit)),
one AS (SELECT word, count(*) AS c FROM seen GROUP BY word),
two AS (
  SELECT a.word AS wa, b.word AS wb, count(*) AS c
  FROM seen a JOIN seen b ON a.row_id = b.row_id AND a.s = b.s AND a.word < b.word GROUP BY 1, 2),
pair_values AS (
  SELECT {by}topic, coalesce(t.c, 0) / n AS pj, oa.c / n AS pa, ob.c / n AS pb
  FROM top_words a JOIN top_words b USING ({by}topic)
  JOIN one oa ON oa.word = a.word JOIN one ob ON ob.word = b.word
  LEFT JOIN two t ON t.wa = a.word AND t.wb = b.word CROSS JOIN tot WHERE a.word < b.word),
npmi AS (
  SELECT {by}topic, avg(ln((pj + 1e-12) / (pa * pb)) / -ln(pj + 1e-12)) AS npmi
  FROM pair_values GROUP BY {by}topic)"""


GOLD = """gold AS (
  SELECT doc_id AS row_id, lang, quality,
         CASE WHEN n_chars < 200 THEN -1 ELSE CAST(substr(source, 4) AS BIGINT) END AS topic
  FROM documents LEFT JOIN labels USING (doc_id))"""


def agreement(source: str, by: str = "") -> str:
    """The textbook formulas with marginal tables."""
    using = f"USING ({by.rstrip(', ')})" if by else "ON true"
    group = f"GROUP BY {by.rstrip(', ')}" if by else ""
    return f"""table_cells AS (
  SELECT {by}lang, topic, CAST(count(*) AS DOUBLE) AS n FROM {source} WHERE topic <> -1 AND lang IS NOT NULL
  GROUP BY {by}lang, topic),
rowsum AS (SELECT {by}lang, sum(n) AS a FROM table_cells GROUP BY {by}lang),
colsum AS (SELECT {by}topic, sum(n) AS b FROM table_cells GROUP BY {by}topic),
al AS (SELECT {by}sum(n) AS nn, sum(n * (n - 1) / 2) AS tog FROM table_cells {group}),
ra AS (SELECT {by}sum(a * (a - 1) / 2) AS sa FROM rowsum {group}),
cb AS (SELECT {by}sum(b * (b - 1) / 2) AS sb FROM colsum {group}),
hg AS (SELECT {by}-sum(a / nn * ln(a / nn)) AS hg FROM rowsum JOIN al {using} {group}),
ht AS (SELECT {by}-sum(b / nn * ln(b / nn)) AS ht FROM colsum JOIN al {using} {group}),
mi AS (
  SELECT {by}sum(n / nn * ln(nn * n / (a * b))) AS mi
  FROM table_cells JOIN rowsum USING ({by}lang) JOIN colsum USING ({by}topic) JOIN al {using} {group}),
scores AS (
  SELECT {by}CAST(coalesce(nn, 0) AS BIGINT) AS n_scored,
    CASE WHEN tog = sa AND tog = sb THEN 1.0 ELSE
      (tog - sa * sb / (nn * (nn - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (nn * (nn - 1) / 2)) END AS ari,
    CASE WHEN round(hg + ht, 12) = 0 THEN 1 ELSE mi / ((hg + ht) / 2) END AS nmi,
    homogeneity, completeness,
    CASE WHEN homogeneity + completeness = 0 THEN 0
         ELSE 2 * homogeneity * completeness / (homogeneity + completeness) END AS v_measure
  FROM (
    SELECT *, CASE WHEN round(hg, 12) = 0 THEN 1 ELSE mi / hg END AS homogeneity,
           CASE WHEN round(ht, 12) = 0 THEN 1 ELSE mi / ht END AS completeness
    FROM al JOIN ra {using} JOIN cb {using} JOIN hg {using} JOIN ht {using} JOIN mi {using}))"""


def number(digest: str, start: int) -> str:
    return f"CAST('0x' || substr({digest}, {start}, 8) AS BIGINT)"


def embedded(dim: int) -> str:
    """``vec (row_id, slot, value)``: non-zero entries of the hashed vectors of tok."""
    return f"""tf AS (
  SELECT row_id, md5(word) AS h, count(*) AS n FROM (SELECT row_id, unnest(tokens) AS word FROM tok) GROUP BY ALL),
hashed AS (
  SELECT row_id, n, {number('h', 1)} % 262144 AS bucket, {number('h', 9)} % {dim} AS slot,
         CASE WHEN substr(h, 17, 1) < '8' THEN 1.0 ELSE -1.0 END AS sgn FROM tf),
freq AS (
  SELECT bucket, ln((1 + (SELECT count(*) FROM tok)) / (1.0 + count(DISTINCT row_id))) AS idf
  FROM hashed GROUP BY bucket),
raw AS (SELECT row_id, slot, sum(n * sgn * idf) AS value FROM hashed JOIN freq USING (bucket) GROUP BY ALL),
vec AS (
  SELECT row_id, slot, value / norm AS value
  FROM raw JOIN (SELECT row_id, sqrt(sum(value * value)) AS norm FROM raw GROUP BY row_id) USING (row_id)
  WHERE norm > 0)"""


EMBEDDINGS = """vec AS (
  SELECT vec_id AS row_id, unnest(embedding)::DOUBLE AS value, unnest(range(len(embedding))) AS slot
  FROM embeddings)"""
LABELLED = EMBEDDINGS + """,
member AS (SELECT vec_id AS row_id, CAST(label AS BIGINT) AS topic FROM embeddings),
center AS (
  SELECT topic, slot, avg(value) AS value FROM vec JOIN member USING (row_id) GROUP BY topic, slot),
size_of AS (SELECT row_id, sqrt(sum(value * value)) AS norm FROM vec GROUP BY row_id),
center_size AS (SELECT topic, sqrt(sum(value * value)) AS cnorm FROM center GROUP BY topic),
sims AS (
  SELECT row_id, topic, round(sum(v.value * c.value) / (any_value(norm) * any_value(cnorm)), 9) AS sim
  FROM vec v JOIN center c USING (slot) JOIN size_of USING (row_id) JOIN center_size USING (topic)
  GROUP BY row_id, topic)"""


def projection(dim: int, k: int) -> str:
    """``red (row_id, slot, value)`` from vec; the signs are the fixed matrix as a table."""
    signs = ", ".join(
        f"({i}, {j}, {1 if hashlib.md5(f':{i}:{j}'.encode()).hexdigest()[0] < '8' else -1})"
        for i in range(dim) for j in range(k)
    )
    return f"""signs(slot, k, sgn) AS (VALUES {signs}),
red AS (
  SELECT row_id, k AS slot, sum(value * sgn) / sqrt({k}) AS value
  FROM vec JOIN signs USING (slot) GROUP BY row_id, k)"""


def density(k: int, width: float, sim: float, min_pts: int, min_size: int) -> str:
    """``final (row_id, topic)`` from red, over all rows of every_row."""
    coords = ", ".join(
        f"max(CASE WHEN slot = {i} THEN value / norm END) AS u{i}" for i in range(k)
    )
    half = int(-(-1 // width))
    steps = ", ".join(f"CAST(floor(round(u{i}, 9) / {width}) AS BIGINT) + {half + 1} AS c{i}" for i in range(k))
    key = " + ".join(f"c{i} * {(2 * half + 3) ** i}" for i in range(k))
    cs = ", ".join(f"c{i}" for i in range(k))
    sums = ", ".join(f"sum(u{i}) AS s{i}" for i in range(k))
    adjacent = " AND ".join(f"abs(a.c{i} - b.c{i}) <= 1" for i in range(k))
    inner = " + ".join(f"a.s{i} * b.s{i}" for i in range(k))

    def norm(t: str) -> str:
        return "sqrt(" + " + ".join(f"{t}.s{i} * {t}.s{i}" for i in range(k)) + ")"

    return f"""unit AS (
  SELECT row_id, {coords} FROM red
  JOIN (SELECT row_id, sqrt(sum(value * value)) AS norm FROM red GROUP BY row_id) USING (row_id)
  WHERE norm > 0 GROUP BY row_id),
stepped AS (SELECT *, {steps} FROM unit),
keyed AS (SELECT *, {key} AS cell FROM stepped),
cells AS (
  SELECT cell, {cs}, count(*) AS cnt, min(row_id) AS first_row, {sums} FROM keyed GROUP BY cell, {cs}),
links AS (
  SELECT a.cell, b.cell AS other, round(({inner}) / ({norm('a')} * {norm('b')}), 9) AS sim, b.cnt
  FROM cells a JOIN cells b ON a.cell <> b.cell AND {adjacent}
  WHERE round(({inner}) / ({norm('a')} * {norm('b')}), 9) >= {sim}),
dens AS (
  SELECT cell, cnt, first_row, cnt + coalesce(around, 0) AS density
  FROM cells LEFT JOIN (SELECT cell, sum(cnt) AS around FROM links GROUP BY cell) USING (cell)),
up AS (
  SELECT cell, other FROM (
    SELECT l.cell, l.other, row_number() OVER (PARTITION BY l.cell ORDER BY l.sim DESC, l.other) AS place
    FROM links l JOIN dens a ON a.cell = l.cell JOIN dens b ON b.cell = l.other
    WHERE b.density > a.density OR (b.density = a.density AND b.cell < a.cell))
  WHERE place = 1),
climb AS (
  SELECT cell, cell AS here FROM dens
  UNION ALL
  SELECT c.cell, u.other FROM climb c JOIN up u ON u.cell = c.here),
grouped AS (SELECT cell, here AS label FROM climb WHERE here NOT IN (SELECT cell FROM up)),
big AS (
  SELECT label, row_number() OVER (ORDER BY sum(cnt) DESC, min(first_row)) - 1 AS topic
  FROM grouped JOIN dens USING (cell) GROUP BY label HAVING sum(cnt) >= {min_size} AND max(density) >= {min_pts}),
final AS (
  SELECT row_id, coalesce(topic, -1) AS topic FROM every_row
  LEFT JOIN keyed USING (row_id) LEFT JOIN grouped USING (cell) LEFT JOIN big USING (label))"""


TAXONOMY_ROWS = ", ".join(
    f"({i}, {text(n1)}, {'NULL' if n2 is None else j}, {'NULL' if n2 is None else text(n2)})"
    for i, (n1, children) in enumerate(subjects().items())
    for j, n2 in enumerate(children or [None])
)
TAXONOMY = f"tax(n1_pos, n1, n2_pos, n2) AS (VALUES {TAXONOMY_ROWS})"

CLEAN_MARK = chr(1)


def cleaned(column: str, drop: tuple[str, ...]) -> str:
    """Word boundaries of any alphabet: words are put between marks first."""
    squeezed = (
        f"regexp_replace(regexp_replace({column}, E'\\n+', ' ', 'g'), {text('[' + WHITESPACE + ']{2,}')}, ' ', 'g')"
    )
    marked = rf"regexp_replace({squeezed}, '([\p{{L}}\p{{N}}_]+)', '{CLEAN_MARK}\1{CLEAN_MARK}', 'g')"
    dropped = f"regexp_replace({marked}, '(?i){CLEAN_MARK}({'|'.join(drop)}){CLEAN_MARK}:?', '', 'g')"
    return f"trim(replace({dropped}, '{CLEAN_MARK}', ''), {SPACE})"


DEFAULT_DROP = ("Item", "Parágrafo", "Artigo")


def label_words(column: str) -> str:
    return f"list_distinct({without_stop_words(counted(column), STOP_PT)})"


def best_option(rows: str, options: str, name: str) -> str:
    """``name (row_id, response)``: rows (row_id, words[, n1]) against options (n1, pos, option)."""
    return f"""{name}_words AS (SELECT *, unnest({label_words('option')}) AS word FROM {options}),
{name}_own AS (SELECT *, len({label_words('option')}) AS size FROM {options}),
{name}_hits AS (
  SELECT r.row_id, w.pos, w.option, count(*) AS hits
  FROM (SELECT DISTINCT row_id, parent, unnest(words) AS word FROM {rows}) r
  JOIN {name}_words w ON w.word = r.word AND w.parent = r.parent GROUP BY 1, 2, 3),
{name} AS (
  SELECT row_id, option AS response FROM (
    SELECT h.row_id, h.option, row_number() OVER (
      PARTITION BY h.row_id ORDER BY round(h.hits / CAST(o.size AS DOUBLE), 9) DESC, h.pos) AS place
    FROM {name}_hits h JOIN {name}_own o ON o.option = h.option AND o.pos = h.pos
      AND o.parent = (SELECT any_value(r.parent) FROM {rows} r WHERE r.row_id = h.row_id))
  WHERE place = 1)"""


def classified() -> str:
    """``labelled (row_id, lang, n1, n2, response_1, response_2)`` for taxonomy ``tax``."""
    return f"""asked1 AS (
  SELECT doc_id AS row_id, lang, '' AS parent, {counted(cleaned('text', DEFAULT_DROP))} AS words FROM documents),
opt1 AS (SELECT DISTINCT '' AS parent, n1_pos AS pos, n1 AS option FROM tax),
{best_option('asked1', 'opt1', 'first')},
asked2 AS (SELECT row_id, response AS parent, words FROM asked1 JOIN first USING (row_id)),
opt2 AS (SELECT n1 AS parent, n2_pos AS pos, n2 AS option FROM tax WHERE n2 IS NOT NULL),
{best_option('asked2', 'opt2', 'second')},
labelled AS (
  SELECT a.row_id, a.lang, f.response AS n1,
    CASE WHEN f.response IS NULL THEN NULL
         WHEN f.response NOT IN (SELECT parent FROM opt2) THEN {text(NO_CHILDREN)}
         ELSE s.response END AS n2,
    f.response AS response_1, s.response AS response_2, CAST(NULL AS VARCHAR) AS error
  FROM asked1 a LEFT JOIN first f USING (row_id) LEFT JOIN second s USING (row_id))"""


def letter_triples(column: str) -> str:
    marked = f"concat('^', translate(lower({column}), '{ACCENTED}', '{PLAIN}'), '$')"
    return f"list_distinct(list_transform(range(1, length({marked}) - 1), lambda i: substr({marked}, i, 3)))"


def spelled(alike: float, share: float) -> str:
    """``first_like`` and ``second_like (row_id, option, share)`` for taxonomy ``tax``."""
    best = "row_number() OVER (PARTITION BY row_id ORDER BY share DESC, pos)"
    second = "row_number() OVER (PARTITION BY r.row_id ORDER BY r.share DESC, r.pos)"
    return f"""text_words AS (
  SELECT DISTINCT doc_id AS row_id, unnest({counted(cleaned('text', DEFAULT_DROP))}) AS word FROM documents WHERE text IS NOT NULL),
options AS (
  SELECT DISTINCT '' AS parent, n1_pos AS pos, n1 AS option FROM tax
  UNION SELECT n1, n2_pos, n2 FROM tax WHERE n2 IS NOT NULL),
owned AS (SELECT *, {label_words('option')} AS own FROM options),
own_words AS (SELECT parent, pos, option, len(own) AS size, unnest(own) AS name_word FROM owned),
text_triples AS (
  SELECT word, len(triples) AS n, unnest(triples) AS triple FROM (
    SELECT word, {letter_triples('word')} AS triples FROM (SELECT DISTINCT word FROM text_words))),
name_triples AS (
  SELECT name_word, len(triples) AS m, unnest(triples) AS triple FROM (
    SELECT name_word, {letter_triples('name_word')} AS triples FROM (SELECT DISTINCT name_word FROM own_words))),
like_words AS (
  SELECT word, name_word, round(count(*) / sqrt(n * m), 9) AS sim
  FROM text_triples JOIN name_triples USING (triple) GROUP BY word, name_word, n, m HAVING sim >= {alike}),
like_found AS (SELECT row_id, name_word, max(sim) AS sim FROM text_words JOIN like_words USING (word) GROUP BY ALL),
rated AS (
  SELECT row_id, parent, pos, option, round(sum(sim ORDER BY sim) / size, 9) AS share
  FROM own_words JOIN like_found USING (name_word) GROUP BY row_id, parent, pos, option, size HAVING share >= {share}),
first_like AS (SELECT row_id, option, share FROM (SELECT *, {best} AS place FROM rated WHERE parent = '') WHERE place = 1),
second_like AS (
  SELECT row_id, option, share FROM (
    SELECT r.*, {second} AS place FROM rated r JOIN first_like f USING (row_id) WHERE r.parent = f.option) WHERE place = 1)"""


WORD_TAXONOMY = f"""{counts('lang')},
{tfidf()},
{top()},
names AS (
  SELECT topic, (rank - 1) // 2 AS pair, string_agg(word, ' ' ORDER BY word) AS name FROM top_words GROUP BY 1, 2),
tax AS (
  SELECT p.n1_pos, p.n1, c.pair - 1 AS n2_pos, c.name AS n2 FROM (
    SELECT topic, topic || ' ' || name AS n1, row_number() OVER (ORDER BY topic) - 1 AS n1_pos FROM names WHERE pair = 0) p
  LEFT JOIN (SELECT * FROM names WHERE pair > 0) c USING (topic)
  UNION ALL SELECT 1000, 'the of', NULL, NULL)"""


def prompt() -> str:
    options = ", ".join(subjects())
    before, rest = PROMPT.split("{options}")
    between, after = rest.split("{text}")
    return (
        f"SELECT doc_id AS row_id, concat({text(before)}, {text(options)}, {text(between)}, "
        f"{cleaned('text', DEFAULT_DROP)}, {text(after)}) AS prompt FROM documents"
    )


def per_text(tokens: str) -> str:
    return (
        f"SELECT row_id, len(tokens) AS n_tokens, {joined('tokens')} AS tokens FROM "
        f"(SELECT doc_id AS row_id, {tokens} AS tokens FROM documents)"
    )


def lower_contains() -> str:
    options = "[" + ", ".join(text(n1) for n1 in subjects()) + "]"
    return f"""WITH listed AS (SELECT conv_id, turn, {counted('text')} AS words FROM conversations),
said AS (
  SELECT conv_id, turn, unnest(range(len(words))) AS place, unnest(words) AS response FROM listed WHERE len(words) > 0
  UNION ALL SELECT conv_id, turn, NULL, NULL FROM listed WHERE coalesce(len(words), 0) = 0)
SELECT conv_id, turn, place, response,
  CASE WHEN list_contains({options}, coalesce(response, '')) THEN response
       ELSE list_filter({options}, lambda o: contains(lower(o), lower(coalesce(response, ''))))[1] END AS label
FROM said"""


def merged_topics(target: int) -> str:
    return f"""{TOKENS},
{GIVEN},
rows_ AS (
  SELECT row_id, tokens, CASE WHEN len(tokens) < 10 THEN -1 ELSE source END AS topic
  FROM tok JOIN given USING (row_id)),
counts AS (
  SELECT topic, word, count(*) AS cnt FROM (SELECT topic, unnest(tokens) AS word FROM rows_) GROUP BY 1, 2),
{tfidf()},
sizes AS (SELECT topic, count(*) AS cnt, min(row_id) AS first_row FROM rows_ GROUP BY topic),
places AS (
  SELECT *, row_number() OVER (ORDER BY cnt DESC, topic) AS place FROM sizes WHERE topic <> -1),
room AS (SELECT {target} - count(*) AS r FROM sizes WHERE topic = -1),
norms AS (SELECT topic, sqrt(sum(weight * weight)) AS norm FROM weights GROUP BY topic),
likeness AS (
  SELECT a.topic, b.topic AS other, any_value(q.place) AS place,
         round(sum(a.weight * b.weight) / (any_value(na.norm) * any_value(nb.norm)), 9) AS sim
  FROM weights a JOIN weights b USING (word)
  JOIN places p ON p.topic = a.topic JOIN places q ON q.topic = b.topic
  JOIN norms na ON na.topic = a.topic JOIN norms nb ON nb.topic = b.topic
  WHERE p.place > (SELECT r FROM room) AND q.place <= (SELECT r FROM room) GROUP BY 1, 2),
into_ AS (
  SELECT topic, topic AS target FROM places WHERE place <= (SELECT r FROM room)
  UNION ALL
  SELECT topic, other FROM (
    SELECT *, row_number() OVER (PARTITION BY topic ORDER BY sim DESC, place) AS best FROM likeness) WHERE best = 1),
numbered AS (
  SELECT target, row_number() OVER (ORDER BY sum(cnt) DESC, min(first_row)) - 1 AS topic
  FROM into_ JOIN sizes USING (topic) GROUP BY target)"""


def grid_runs() -> str:
    models = ("source", "lang", "none")
    targets = (4, 7, None)
    configs = ", ".join(
        f"({i}, '{m}', {'NULL' if t is None else t})"
        for i, (m, t) in enumerate((m, t) for m in models for t in targets)
    )
    return f"""{TOKENS},
{GIVEN},
{WORDS_OF},
configs AS (
  SELECT CAST(config_id AS BIGINT) AS config_id, model, nr_topics
  FROM (VALUES {configs}) AS c(config_id, model, nr_topics)),
grid AS (SELECT *, unnest(range(3)) AS iteration FROM configs),
groups AS (SELECT lang, source, word, count(*) AS cnt FROM words_of JOIN given USING (row_id) GROUP BY 1, 2, 3),
assigned AS (
  SELECT config_id, iteration, lang, source,
    {number("md5(concat(iteration, ':', CASE WHEN model = 'lang' THEN lang ELSE CAST(source AS VARCHAR) END))", 1)}
      % coalesce(nr_topics, 10) AS topic
  FROM grid CROSS JOIN (SELECT DISTINCT lang, source FROM groups) WHERE model <> 'none'),
counts AS (
  SELECT config_id, iteration, topic, word, sum(cnt) AS cnt
  FROM assigned JOIN groups USING (lang, source) GROUP BY ALL),
{tfidf('config_id, iteration, ')},
{top(10, 'config_id, iteration, ')},
{npmi('config_id, iteration, ')},
coherence AS (SELECT config_id, iteration, avg(npmi) AS nc FROM npmi GROUP BY ALL),
diversity AS (
  SELECT config_id, iteration, count(DISTINCT word) / count(*) AS nd FROM top_words GROUP BY ALL),
found AS (SELECT config_id, iteration, count(DISTINCT topic) AS num_topics_found FROM assigned GROUP BY ALL),
runs AS (
  SELECT config_id, model, iteration, num_topics_found, nc, nd, 0.8 * nc AS wc, 0.2 * nd AS wd,
         0.8 * nc + 0.2 * nd AS ws
  FROM grid LEFT JOIN found USING (config_id, iteration) LEFT JOIN coherence USING (config_id, iteration)
  LEFT JOIN diversity USING (config_id, iteration))"""


def rounded(names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names.split())


FITTED = (
    TOKENS, embedded(64), "every_row AS (SELECT row_id FROM tok)", projection(64, 4),
    density(4, 0.25, 0.9, 10, 10),
)


def nearest_fitted(vectors: str) -> str:
    """``nearest (row_id, topic, sim)``: rows of a sparse vector table against the fitted topics."""
    return f"""members AS (SELECT topic, count(*) AS n FROM final WHERE topic <> -1 GROUP BY topic),
fitted AS (
  SELECT topic, slot, sum(value) / any_value(n) AS value
  FROM vec JOIN final USING (row_id) JOIN members USING (topic) GROUP BY topic, slot),
fitted_size AS (SELECT topic, sqrt(sum(value * value)) AS cnorm FROM fitted GROUP BY topic),
row_size AS (SELECT row_id, sqrt(sum(value * value)) AS norm FROM {vectors} GROUP BY row_id),
nearest AS (
  SELECT row_id, coalesce(topic, -1) AS topic, sim FROM row_size LEFT JOIN (
    SELECT row_id, topic, sim, row_number() OVER (PARTITION BY row_id ORDER BY sim DESC, topic) AS place
    FROM (
      SELECT v.row_id, f.topic, round(sum(v.value * f.value) / (any_value(norm) * any_value(cnorm)), 9) AS sim
      FROM {vectors} v JOIN fitted f USING (slot) JOIN fitted_size USING (topic) JOIN row_size USING (row_id)
      GROUP BY 1, 2)) USING (row_id)
  WHERE place IS NULL OR place = 1)"""


def one_fit(condition: str, last: str) -> str:
    """A subquery: cells and topics of the documents that meet a condition, with words of weight 1, coordinates summed
    as millionths, and equal topics ordered by cell."""
    chosen = PREPARED + f""",
tok AS (SELECT row_id, {counted('clean_text')} AS tokens FROM prepared
  WHERE row_id IN (SELECT doc_id FROM documents WHERE {condition}))"""
    found = density(4, 0.25, 0.9, 10, 10).replace("min(first_row)", "min(cell)")
    for i in range(4):
        found = found.replace(f"sum(u{i})", f"sum(CAST(round(u{i} * 1000000) AS BIGINT))")
    parts = chosen, embedded(64).replace("n * sgn * idf", "n * sgn"), "every_row AS (SELECT row_id FROM tok)", projection(64, 4), found
    return "(" + with_(*parts, last=last, recursive=True) + ")"


def grown(*parts: str, last: str) -> str:
    """``now (cell, cnt, n_tokens, n_words, topic)`` and ``words (cell, word, cnt)`` after both batches."""
    left = "doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"
    return with_(
        "old AS " + one_fit(
            "CAST(substr(source, 4) AS BIGINT) < 10",
            "SELECT cell, topic AS old FROM cells JOIN grouped USING (cell) JOIN big USING (label)",
        ),
        "new AS " + one_fit(
            left, "SELECT cell, cnt, topic AS found FROM cells LEFT JOIN grouped USING (cell) LEFT JOIN big USING (label)"
        ),
        "words AS " + one_fit(
            left, """SELECT coalesce(cell, -1) AS cell, word, count(*) AS cnt FROM (SELECT row_id, unnest(tokens) AS word FROM tok)
  LEFT JOIN keyed USING (row_id) GROUP BY 1, 2""",
        ),
        """shared AS (SELECT found, old, sum(cnt) AS cnt FROM new JOIN old USING (cell) WHERE found IS NOT NULL GROUP BY 1, 2),
most AS (SELECT found, first(old ORDER BY cnt DESC, old) AS old FROM shared GROUP BY 1),
heirs AS (SELECT old, first(found ORDER BY cnt DESC, found) AS found FROM shared GROUP BY 1),
named AS (
  SELECT found, coalesce(old, row_number() OVER (PARTITION BY old IS NULL ORDER BY found)
         + coalesce((SELECT max(old) FROM old), -1)) AS topic
  FROM (SELECT DISTINCT found FROM new WHERE found IS NOT NULL)
  LEFT JOIN (SELECT * FROM most JOIN heirs USING (found, old)) USING (found)),
now AS (SELECT cell, cnt, CAST(coalesce(topic, -1) AS BIGINT) AS topic FROM new LEFT JOIN named USING (found))""",
        *parts, last=last,
    )


SEED_WORDS = f"seed_words AS (SELECT DISTINCT unnest({counted('text')}) AS word FROM benchmark)"
SCORES = "ari nmi homogeneity completeness v_measure"
EVERY_VECTOR = "every_row AS (SELECT vec_id AS row_id FROM embeddings)"

# --------------------------------------------------------------------------- oracles

SIMILAR = f"""texts AS (
  SELECT doc_id AS row_id, list_sort({counted('text')}) AS tokens FROM documents),
classes AS (SELECT tokens, min(row_id) AS representative, count(*) AS class_size FROM texts GROUP BY tokens),
tf AS (
  SELECT representative AS r, word, count(*) AS tf FROM (SELECT representative, unnest(tokens) AS word FROM classes) GROUP BY ALL),
raw AS (
  SELECT r, word, tf * ln((SELECT count(*) FROM classes) / CAST(count(*) OVER (PARTITION BY word) AS DOUBLE)) AS w FROM tf),
unit AS (SELECT r, word, w / sqrt(sum(w * w) OVER (PARTITION BY r)) AS w FROM raw WHERE w > 0),
links AS (
  SELECT a.r AS representative, b.r AS other, round(sum(a.w * b.w), 9) AS sim
  FROM unit a JOIN unit b ON a.word = b.word AND a.r <> b.r GROUP BY ALL HAVING round(sum(a.w * b.w), 9) >= 0.8)"""

PHRASES = f"""texts AS (
  SELECT doc_id, lang, {counted('text')} AS tokens FROM documents),
singles AS (
  SELECT doc_id, lang, tokens, unnest(range(1, len(tokens) + 1)) AS p FROM texts),
heads AS (
  SELECT {counted('text')} AS w FROM benchmark),
seed_parts AS (
  SELECT unnest([w[1:2], w[1:3], w[3:4]]) AS part FROM heads),
seed_words AS (
  SELECT DISTINCT unnest(part) AS word FROM seed_parts
  UNION SELECT array_to_string(part, ' ') FROM seed_parts WHERE len(part) > 1),
phrase_counts AS (
  SELECT lang AS topic, word, count(*) AS cnt FROM (
    SELECT lang, array_to_string(tokens[p:p + n], ' ') AS word
    FROM singles CROSS JOIN (SELECT unnest([1, 2]) AS n) WHERE p + n <= len(tokens))
  WHERE word IN (SELECT array_to_string(part, ' ') FROM seed_parts WHERE len(part) > 1) GROUP BY 1, 2),
counts AS (
  SELECT lang AS topic, tokens[p] AS word, count(*) AS cnt FROM singles GROUP BY 1, 2
  UNION ALL SELECT * FROM phrase_counts)"""

# As checks.queries has them.
RULES = [("s", ""), ("ers", "er"), ("ions", "ion"), ("ed", "er"), ("ed", ""), ("ing", ""), ("ing", "ion"), ("ly", "")]
HALVES = f"""words AS (
  SELECT DISTINCT unnest({simple('text')}) AS word FROM documents),
lexicon AS (
  SELECT a.word AS token, b.word AS lemma FROM words a JOIN words b ON a.word = b.word || 's' WHERE substr(md5(a.word), 1, 1) < '8'
  UNION ALL SELECT word, word FROM words WHERE ends_with(word, 'er') OR ends_with(word, 'ion'))"""

ORACLES = {
    "prepare_corpus": with_(
        PREPARED,
        last="SELECT row_id, original_text, clean_text, len(tokens) AS n_tokens FROM prepared",
    ),
    "prepare_null_literal": with_(
        "gaps AS (SELECT doc_id, coalesce(CASE WHEN quality IS NOT NULL THEN text END, 'nan') AS text "
        "FROM documents LEFT JOIN labels USING (doc_id))",
        prepared("gaps", "text", "doc_id"),
        last="SELECT row_id, original_text, clean_text FROM prepared",
    ),
    "tokenize_simple": per_text(simple("text")),
    "tokenize_model": per_text(counted("text")),
    "ngrams_1_2": f"""SELECT row_id, len(grams) AS n_grams, {joined('grams', '|')} AS grams FROM (
  SELECT row_id, list_concat(t, list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1])) AS grams
  FROM (SELECT doc_id AS row_id, {counted('text')} AS t FROM documents))""",
    "remove_stopwords": per_text(without_stop_words(simple("text"))),
    "lemmatize_lexicon": f"""WITH t AS (
  SELECT row_id, unnest(tokens) AS word, unnest(range(len(tokens))) AS p
  FROM (SELECT doc_id AS row_id, {simple('text')} AS tokens FROM documents)),
v AS (SELECT DISTINCT word FROM t),
lexicon AS (
  SELECT a.word, b.word AS lemma FROM v a JOIN v b ON a.word = b.word || 's')
SELECT doc_id AS row_id, coalesce(clean_text, '') AS clean_text FROM documents LEFT JOIN (
  SELECT row_id, string_agg(coalesce(lemma, word), ' ' ORDER BY p) AS clean_text
  FROM t LEFT JOIN lexicon USING (word) GROUP BY row_id) ON row_id = doc_id""",
    "detached_lemmas": f"""WITH {HALVES},
rules(ending, replacement, weight) AS (VALUES {', '.join(f"('{a}', '{b}', {8 - i})" for i, (a, b) in enumerate(RULES))}),
exceptions(word, excepted) AS (VALUES ('the', 'article'), ('and', 'conjunction')),
found AS (
  SELECT word, excepted, listed FROM words LEFT JOIN exceptions USING (word)
  LEFT JOIN (SELECT token AS word, min(lemma) AS listed FROM lexicon GROUP BY token) USING (word)),
detached AS (
  SELECT word, first(made ORDER BY length(ending) DESC, weight DESC, made) AS made FROM (
    SELECT word, ending, weight, left(word, length(word) - length(ending)) || replacement AS made
    FROM found JOIN rules ON ends_with(word, ending) AND length(word) - length(ending) >= 2
    WHERE listed IS NULL AND excepted IS NULL)
  WHERE made IN (SELECT lemma FROM lexicon) GROUP BY word)
SELECT word, coalesce(excepted, listed, made, word) AS lemma,
       CASE WHEN excepted IS NOT NULL THEN 'exception' WHEN listed IS NOT NULL THEN 'lexicon'
            WHEN made IS NOT NULL THEN 'rule' ELSE 'none' END AS found_by
FROM found LEFT JOIN detached USING (word)""",
    "induced_rules": f"""WITH {HALVES}
SELECT right(a.word, n) AS ending, '' AS replacement, count(*) AS weight
FROM (SELECT word, unnest([2, 3]) AS n FROM words WHERE length(word) > 5) a JOIN words b ON b.word = left(a.word, length(a.word) - n)
GROUP BY 1 HAVING count(*) >= 3""",
    "clean_text": f"SELECT doc_id AS row_id, {cleaned('text', ('the', 'der', 'que', 'les'))} AS clean_text FROM documents",
    "vocabulary": with_(TOKENS, WORDS_OF, VOCABULARY, last="SELECT * FROM vocab"),
    "topic_term_counts": with_(counts("lang"), last="SELECT * FROM counts"),
    "class_tfidf_topn": with_(counts("lang"), tfidf(), top(), last="SELECT * FROM top_words"),
    "class_tfidf_seeded": with_(
        counts("lang"), SEED_WORDS, tfidf(seeds=True), top(), last="SELECT * FROM top_words"
    ),
    "unmatched_seeds": with_(
        TOKENS, WORDS_OF, VOCABULARY, SEED_WORDS,
        last="SELECT word FROM seed_words WHERE word NOT IN (SELECT word FROM vocab)",
    ),
    "phrase_counts": with_(PHRASES, last="SELECT * FROM phrase_counts"),
    "class_tfidf_phrases": with_(PHRASES, tfidf(seeds=True).replace("THEN 2 ELSE 1", "THEN 50 ELSE 1"), top(), last="SELECT * FROM top_words"),
    "unmatched_phrases": with_(PHRASES, last="SELECT word FROM seed_words WHERE word NOT IN (SELECT word FROM counts)"),
    "similar_texts": with_(SIMILAR, last="""SELECT row_id, representative,
  CAST(class_size - 1 + coalesce(around, 0) AS BIGINT) AS n_links FROM texts JOIN classes USING (tokens) LEFT JOIN (
    SELECT l.representative, sum(c.class_size) AS around FROM links l JOIN classes c ON c.representative = l.other GROUP BY 1)
  USING (representative)"""),
    "similar_text_links": with_(SIMILAR, last="SELECT representative, other, round(sim, 6) AS sim FROM links"),
    "nearest_of_many": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sims AS (
  SELECT a.vec_id AS row_id, b.vec_id AS topic, round(list_cosine_similarity(list_reverse(a.e), b.e), 9) AS sim FROM v a CROSS JOIN v b)
SELECT row_id, first(topic ORDER BY sim DESC, topic) AS topic, round(greatest(0, least(1, max(sim))), 6) AS probability
FROM sims GROUP BY row_id""",
    "topic_info": with_(
        counts("source"), tfidf(), top(),
        last="""SELECT topic, cnt, concat(topic, '_', name) AS name, representation FROM (
  SELECT source AS topic, count(*) AS cnt FROM tok JOIN given USING (row_id) GROUP BY 1) JOIN (
  SELECT topic, string_agg(word, '_' ORDER BY rank) FILTER (rank <= 4) AS name,
         string_agg(word, ' ' ORDER BY rank) AS representation FROM top_words GROUP BY topic) USING (topic)""",
    ),
    "topics_found": with_(
        GOLD,
        last="SELECT lang, count(DISTINCT topic) FILTER (topic <> -1) AS topics_found FROM gold GROUP BY lang",
    ),
    "representative_docs": with_(
        LABELLED,
        last="""SELECT topic, rank, row_id, round(sim, 6) AS sim FROM (
  SELECT topic, row_id, sim, row_number() OVER (PARTITION BY topic ORDER BY sim DESC, row_id) AS rank
  FROM sims JOIN member USING (row_id, topic)) WHERE rank <= 3""",
    ),
    "topic_diversity": with_(
        counts("source"), tfidf(), top(25),
        last="SELECT round(count(DISTINCT word) / count(*), 9) AS nd FROM top_words",
    ),
    "npmi_coherence": with_(
        counts("lang"), tfidf(), top(), npmi(), last="SELECT topic, round(npmi, 6) AS npmi FROM npmi"
    ),
    "weighted_score": with_(
        counts("source"), tfidf(), top(), npmi(),
        last=f"""SELECT {rounded('nc nd')}, round(0.8 * nc, 6) AS wc, round(0.2 * nd, 6) AS wd,
  round(0.8 * nc + 0.2 * nd, 6) AS ws
FROM (SELECT avg(npmi) AS nc FROM npmi), (SELECT count(DISTINCT word) / count(*) AS nd FROM top_words)""",
    ),
    "contingency": with_(
        GOLD,
        last="SELECT lang AS gold, topic, count(*) AS cnt FROM gold WHERE topic <> -1 AND lang IS NOT NULL GROUP BY ALL",
    ),
    "coverage": with_(
        GOLD,
        last="""SELECT count(*) AS n_rows, count(*) FILTER (topic <> -1 AND quality IS NOT NULL) AS n_scored,
  round(count(*) FILTER (topic <> -1 AND quality IS NOT NULL) / count(*), 9) AS coverage FROM gold""",
    ),
    "ari": with_(GOLD, agreement("gold"), last="SELECT n_scored, round(ari, 9) AS ari FROM scores"),
    "nmi": with_(GOLD, agreement("gold"), last="SELECT n_scored, round(nmi, 9) AS nmi FROM scores"),
    "v_measure": with_(
        GOLD, agreement("gold"),
        last=f"SELECT {rounded('homogeneity completeness v_measure', 9)} FROM scores",
    ),
    "agreement_by_quality": with_(
        GOLD, "known AS (SELECT * REPLACE (CAST(quality AS BIGINT) AS quality) FROM gold WHERE quality IS NOT NULL)",
        agreement("known", "quality, "),
        last=f"SELECT quality, n_scored, {rounded(SCORES, 9)} FROM scores",
    ),
    "hash_embed": with_(
        TOKENS, embedded(256),
        last="SELECT row_id, slot, round(value, 6) AS value FROM vec WHERE round(value, 6) <> 0",
    ),
    "random_projection": with_(
        EMBEDDINGS, projection(64, 5),
        last="SELECT row_id, CAST(slot AS BIGINT) AS slot, round(value, 6) AS value FROM red",
    ),
    "similar_cells": with_(
        EMBEDDINGS, EVERY_VECTOR, projection(64, 3), density(3, 0.25, 0.95, 7, 10),
        last="SELECT cell, other, round(sim, 6) AS sim, cnt FROM links", recursive=True,
    ),
    "density_topics": with_(
        EMBEDDINGS, EVERY_VECTOR, projection(64, 3), density(3, 0.25, 0.95, 7, 10),
        last="SELECT * FROM final", recursive=True,
    ),
    "topic_centroids": with_(LABELLED, last="SELECT topic, slot, round(value, 6) AS value FROM center"),
    "assign_nearest": with_(
        LABELLED,
        last="""SELECT row_id, CASE WHEN sim >= 0.1 THEN topic ELSE -1 END AS topic,
  round(greatest(0, least(1, sim)), 6) AS probability FROM (
  SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY sim DESC, topic) AS place FROM sims) WHERE place = 1""",
    ),
    "seed_guide": with_(
        LABELLED,
        """overall AS (SELECT slot, avg(value) AS value FROM vec GROUP BY slot),
overall_sims AS (
  SELECT row_id, round(sum(v.value * o.value) / (any_value(norm) * (SELECT sqrt(sum(value * value)) FROM overall)), 9) AS sim
  FROM vec v JOIN overall o USING (slot) JOIN size_of USING (row_id) GROUP BY row_id),
choice AS (
  SELECT row_id, CASE WHEN s.sim >= o.sim THEN topic ELSE -1 END AS seed_topic FROM (
    SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY sim DESC, topic) AS place FROM sims) s
  JOIN overall_sims o USING (row_id) WHERE place = 1)""",
        last="""SELECT row_id, seed_topic, slot,
  round(CASE WHEN seed_topic = -1 THEN v.value ELSE (3 * v.value + c.value) / 4 END, 6) AS value
FROM vec v JOIN choice USING (row_id) LEFT JOIN center c USING (slot) WHERE c.topic = seed_topic
UNION ALL SELECT row_id, -1, slot, round(value, 6) FROM vec JOIN choice USING (row_id) WHERE seed_topic = -1""",
    ),
    "reduce_topics": with_(
        merged_topics(8),
        last="""SELECT row_id, coalesce(n.topic, -1) AS topic
FROM rows_ r LEFT JOIN into_ i ON i.topic = r.topic LEFT JOIN numbered n ON n.target = i.target""",
    ),
    "topic_merge_tree": with_(
        merged_topics(8),
        """pair_sims AS (
  SELECT a.topic, b.topic AS other, round(sum(a.weight * b.weight) / (any_value(na.norm) * any_value(nb.norm)), 9) AS sim
  FROM weights a JOIN weights b USING (word) JOIN norms na ON na.topic = a.topic JOIN norms nb ON nb.topic = b.topic
  WHERE a.topic < b.topic AND a.topic <> -1 GROUP BY 1, 2),
state(step, topic, grp, cnt, kept, gone, sim) AS (
  SELECT CAST(0 AS BIGINT), topic, topic, CAST(cnt AS DOUBLE), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS DOUBLE)
  FROM sizes WHERE topic <> -1
  UNION ALL
  SELECT s.step + 1, s.topic, CASE WHEN s.grp = b.gone THEN b.kept ELSE s.grp END, s.cnt, b.kept, b.gone, b.sim
  FROM state s CROSS JOIN (
    SELECT x.grp AS kept, y.grp AS gone, round(sum(coalesce(q.sim, 0) * x.cnt * y.cnt) / sum(x.cnt * y.cnt), 9) AS sim
    FROM state x JOIN state y ON x.grp < y.grp
    LEFT JOIN pair_sims q ON q.topic = least(x.topic, y.topic) AND q.other = greatest(x.topic, y.topic)
    GROUP BY 1, 2 ORDER BY sim DESC, kept, gone LIMIT 1) b)""",
        last="SELECT DISTINCT kept, gone, sim, step FROM state WHERE step > 0",
        recursive=True,
    ),
    "taxonomy_usage": with_(
        TOKENS, WORDS_OF, VOCABULARY, TAXONOMY,
        f"named AS (SELECT *, unnest(list_distinct({counted('coalesce(n2, n1)')})) AS word FROM tax)",
        last="""SELECT CAST(n1_pos AS BIGINT) AS n1_pos, n1, CAST(n2_pos AS BIGINT) AS n2_pos, n2, word,
  coalesce(df, 0) AS df FROM named LEFT JOIN vocab USING (word)""",
    ),
    "seed_groups": with_(
        TOKENS, WORDS_OF, VOCABULARY, TAXONOMY,
        """phrases AS (
  SELECT DISTINCT n1_pos, lower(n1) AS seed FROM tax
  UNION ALL SELECT n1_pos, lower(n2) FROM tax WHERE n2_pos < 2)""",
        f"named AS (SELECT n1_pos, seed, unnest({counted('seed')}) AS word FROM phrases)",
        last="""SELECT CAST(n1_pos AS BIGINT) AS seed_topic, count(DISTINCT seed) AS phrases, count(*) AS words,
  CAST(coalesce(sum(df), 0) AS BIGINT) AS uses FROM named LEFT JOIN vocab USING (word) GROUP BY n1_pos""",
    ),
    "prompt_build": prompt(),
    "validate_response": lower_contains(),
    "classify_two_level": with_(TAXONOMY, classified(), last="SELECT * FROM labelled"),
    "classify_word_taxonomy": with_(
        WORD_TAXONOMY, classified(), last="SELECT * EXCLUDE (lang) FROM labelled"
    ),
    "classify_by_spelling": with_(
        WORD_TAXONOMY, spelled(0.6, 0.5),
        last=f"""SELECT d.doc_id AS row_id, f.option AS n1,
  CASE WHEN f.option IS NULL THEN NULL
       WHEN f.option NOT IN (SELECT n1 FROM tax WHERE n2 IS NOT NULL) THEN {text(NO_CHILDREN)} ELSE s.option END AS n2,
  f.share AS share_1, s.share AS share_2
FROM documents d LEFT JOIN first_like f ON f.row_id = d.doc_id LEFT JOIN second_like s ON s.row_id = d.doc_id""",
    ),
    "label_distribution": with_(
        WORD_TAXONOMY, classified(),
        last="""SELECT n1, n2, count(*) AS cnt, count(response_1) AS answered, count(n1) AS validated
FROM labelled GROUP BY n1, n2""",
    ),
    "attach_labels": with_(
        WORD_TAXONOMY, classified(),
        last='SELECT row_id, lang, n1 AS "VCGE_N1", n2 AS "VCGE_N2" FROM labelled',
    ),
    "fit_topics": with_(*FITTED, last="SELECT * FROM final", recursive=True),
    "fit_info_projected": with_(
        *FITTED,
        """counts AS (
  SELECT topic, word, count(*) AS cnt FROM (SELECT row_id, unnest(tokens) AS word FROM tok)
  JOIN final USING (row_id) GROUP BY 1, 2)""",
        tfidf(), top(),
        last="""SELECT topic, cnt, concat(topic, '_', name) AS name, representation,
  CASE WHEN topic = -1 THEN NULL ELSE least(cnt, 3) END AS docs FROM (
  SELECT topic, count(*) AS cnt FROM final GROUP BY 1) JOIN (
  SELECT topic, string_agg(word, '_' ORDER BY rank) FILTER (rank <= 4) AS name,
         string_agg(word, ' ' ORDER BY rank) AS representation FROM top_words GROUP BY topic) USING (topic)""",
        recursive=True,
    ),
    "grown_cells": grown(
        last="""SELECT cell, now.cnt, n_tokens, n_words, topic FROM now LEFT JOIN (
  SELECT cell, CAST(sum(cnt) AS BIGINT) AS n_tokens, count(*) AS n_words FROM words GROUP BY cell) USING (cell)""",
    ),
    "grown_words": grown(
        """counts AS (
  SELECT CAST(coalesce(topic, -1) AS BIGINT) AS topic, word, sum(words.cnt) AS cnt FROM words LEFT JOIN now USING (cell) GROUP BY 1, 2)""",
        tfidf(), top(), last=f"SELECT topic, rank, word, {rounded('weight')} FROM top_words",
    ),
    "evaluate_external": with_(
        *FITTED, nearest_fitted("vec"),
        "compared AS (SELECT row_id, topic, lang FROM nearest JOIN documents ON doc_id = row_id)",
        agreement("compared"),
        last=f"""SELECT n_scored, {rounded(SCORES, 9)}, (SELECT count(*) FROM compared) AS n_rows,
  round(n_scored / (SELECT count(*) FROM compared), 9) AS coverage FROM scores""",
        recursive=True,
    ),
    "assign_benchmark": with_(
        *FITTED, prepared("benchmark", "text", "item_id", "items"),
        f"""item_words AS (
  SELECT row_id, md5(word) AS h, count(*) AS n FROM (
    SELECT row_id, unnest({counted('clean_text')}) AS word FROM items) GROUP BY ALL),
item_raw AS (
  SELECT row_id, slot, sum(n * sgn * coalesce(idf, ln(1.0 + (SELECT count(*) FROM tok)))) AS value FROM (
    SELECT row_id, n, {number('h', 1)} % 262144 AS bucket, {number('h', 9)} % 64 AS slot,
           CASE WHEN substr(h, 17, 1) < '8' THEN 1.0 ELSE -1.0 END AS sgn FROM item_words)
  LEFT JOIN freq USING (bucket) GROUP BY row_id, slot)""",
        nearest_fitted("item_raw"),
        last="""SELECT row_id, CASE WHEN sim >= 0.05 THEN topic ELSE -1 END AS topic,
  CASE WHEN sim IS NOT NULL THEN round(greatest(0, least(1, sim)), 6) END AS probability FROM nearest""",
        recursive=True,
    ),
    "align_predictions": with_(
        PREPARED, GIVEN,
        last="""SELECT row_id, original_text, lang AS "VCGE_N1", source AS "VCGE_N2", len(tokens) AS topic,
  round(len(tokens) / length(original_text), 6) AS probability FROM prepared JOIN given USING (row_id)""",
    ),
    "kept_rows": with_(
        PREPARED, GIVEN,
        last="SELECT row_id, lang, source FROM given WHERE row_id IN (SELECT row_id FROM prepared)",
    ),
    "grid_scores": with_(
        grid_runs(),
        last=f"SELECT config_id, model, iteration, num_topics_found, {rounded('nc nd wc wd ws')} FROM runs",
    ),
    "grid_leaderboard": with_(
        grid_runs(),
        last=f"""SELECT config_id, model, {rounded('num_topics_found nc nd wc wd ws', 5)}, valid_iters FROM (
  SELECT config_id, model, avg(num_topics_found) AS num_topics_found, avg(nc) AS nc, avg(nd) AS nd,
         avg(wc) AS wc, avg(wd) AS wd, avg(ws) AS ws, count(nc) AS valid_iters FROM runs GROUP BY 1, 2)""",
    ),
    "highest_probability": """SELECT vec_id AS row_id, round(CAST(list_max(embedding) AS DOUBLE), 6) AS probability
FROM embeddings""",
    "append_runs": """SELECT lang, NULL AS source, count(*) AS num_topics_found, NULL AS nc FROM documents GROUP BY lang
UNION ALL
SELECT NULL, CAST(substr(source, 4) AS BIGINT), count(*), round(avg(n_chars), 6) FROM documents GROUP BY source""",
    "failed_responses": """SELECT conv_id, turn,
  CASE WHEN strlen(text) >= 60 THEN substr(text, 1, 1) END AS response,
  CASE WHEN strlen(text) < 60 THEN concat(strlen(text), ' bytes are too few') END AS error FROM conversations""",
    "csv_round_trip": "SELECT doc_id AS row_id, text AS proposal_text FROM documents",
    "csv_split_read": """SELECT doc_id AS row_id, lang, source, md5(text) AS text_md5,
  length(text) - length(replace(text, chr(10), '')) AS line_breaks FROM documents""",
    "decimal_comma": """SELECT lang, CAST(CAST(substr(source, 4) AS BIGINT) AS VARCHAR) AS source,
  replace(CAST(round(avg(n_chars), 2) AS VARCHAR), '.', ',') AS mean_chars FROM documents GROUP BY 1, 2""",
}
