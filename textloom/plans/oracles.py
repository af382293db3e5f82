"""DuckDB SQL for the registered queries, on the same tables and inline rows."""

from __future__ import annotations

from textloom.functions.citations import BIBLIOGRAPHY, BLOCK_QUOTE, DOUBLE_QUOTE, FOOTNOTE, INLINE, NUMBERED, PHRASE, SINGLE_QUOTE, URL
from textloom.functions.style import BE_VERBS, HEDGES
from textloom.functions.text import DOCUMENT_ENDINGS, INDONESIAN_FUNCTION_WORDS, INDONESIAN_MARKERS, INDONESIAN_STOPWORDS, UPLOAD_ENDINGS
from textloom.operators.similarity import PRIME, hash_factors
from textloom.plans.inline import values
from textloom.sources.payloads import BODY_END, NO_ARTICLE, TITLE_END


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def among(words: list[str]) -> str:
    return "(" + ", ".join(map(lit, dict.fromkeys(words))) + ")"


WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
SPACE = r"[\s\p{Z}]+"
BLANK_WORDS = r"list_filter(regexp_split_to_array({0}, '[\s\p{{Z}}]+'), lambda x: x <> '')"
TRIMMED = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
SHINGLES = "list_distinct(CASE WHEN len({0}) = 0 THEN []::VARCHAR[] WHEN len({0}) < 3 THEN [array_to_string({0}, ' ')] ELSE [array_to_string({0}[i:i + 2], ' ') FOR i IN range(1, len({0}) - 1)] END)"


def rows(name: str = "texts") -> str:
    return f"(SELECT -id AS id, text FROM {values(name)} UNION ALL SELECT doc_id, text FROM documents)"


CHUNKS = """chunks AS (
  SELECT doc_id * 1000000 + k AS chunk_id, doc_id, k AS chunk_no, CASE WHEN length(text) <= 1500 THEN text ELSE substr(text, k * 1300 + 1, 1500) END AS text
  FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 1500 THEN 1 ELSE (length(text) + 1299) // 1300 END)) AS k FROM documents)
)"""


def blocks(source: str, key: str) -> str:
    """Paragraphs with a minimum of 80 characters and the fallback, from (key, text)."""
    return f"""bl AS (
  SELECT {key}, pos, {TRIMMED.format('b')} AS b FROM (SELECT {key}, unnest(range(len(p))) AS pos, unnest(p) AS b FROM (SELECT {key}, string_split(text, chr(10) || chr(10)) AS p FROM {source}))
), gr AS (
  SELECT *, sum((length(b) >= 80)::INT) OVER (PARTITION BY {key} ORDER BY pos) AS g FROM bl WHERE b <> ''
), paras AS (
  SELECT {key}, g - 1 AS para_no, string_agg(b, ' ' ORDER BY pos) AS para FROM gr WHERE g > 0 GROUP BY {key}, g
  UNION ALL SELECT {key}, 0, text FROM {source} WHERE {TRIMMED.format('text')} <> '' AND {key} NOT IN (SELECT {key} FROM gr WHERE g > 0)
)"""


BROKEN = "(SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents)"


def signature(source: str, key: str, to: str) -> str:
    """(key, slot, m) of MinHash minima."""
    table = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(hash_factors()))
    return f"""{to}_h AS (
  SELECT {key}, ('0x' || substr(md5(s), 1, 7))::BIGINT AS h FROM (SELECT {key}, unnest({SHINGLES.format('w')}) AS s FROM (SELECT {key}, {WORDS.format('text')} AS w FROM {source}))
), {to} AS (
  SELECT {key}, slot, min((h * a + b) % {PRIME}) AS m FROM {to}_h, (VALUES {table}) AS f(slot, a, b) GROUP BY {key}, slot
)"""


BANDS = "(SELECT {1}, slot // 3 AS band, md5(string_agg(m::VARCHAR, ',' ORDER BY slot)) AS key FROM {0} WHERE slot < 111 GROUP BY {1}, slot // 3)"
PAIRS = f"""slots AS (SELECT item_id, chunk_id, count(*) AS equal FROM sp JOIN sc USING (slot, m) GROUP BY ALL),
lsh AS (SELECT DISTINCT item_id, chunk_id FROM {BANDS.format('sp', 'item_id')} JOIN {BANDS.format('sc', 'chunk_id')} USING (band, key))"""
SIGNED = f"{CHUNKS}, {signature('benchmark', 'item_id', 'sp')}, {signature('chunks', 'chunk_id', 'sc')}, {PAIRS}"


def windows(source: str) -> str:
    """(chunk_id, i, j): visited and scored windows of the words of ``source``."""
    return f"""w AS (
  SELECT chunk_id, unnest(range(len(a))) AS i, unnest(a) AS w, len(a) AS n FROM (SELECT chunk_id, {BLANK_WORDS.format('text')} AS a FROM {source})
), cu AS (
  SELECT *, coalesce(sum(length(w) + 1) OVER (PARTITION BY chunk_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM w
), nx AS (
  SELECT a.chunk_id, a.i, a.n, a.i + count(*) FILTER (b.c < a.c + 400) AS j, a.i + count(*) FILTER (b.c < a.c + 100) AS k, bool_or(regexp_matches(b.w, '[\\p{{L}}\\p{{N}}_]')) AS ok
  FROM cu a JOIN cu b ON a.chunk_id = b.chunk_id AND b.i >= a.i AND b.c < a.c + 400 GROUP BY a.chunk_id, a.i, a.n
), st AS (
  SELECT *, j - i >= 3 AND ok AS scored, CASE WHEN NOT (j - i >= 3 AND ok) THEN i + 1 WHEN j >= n THEN NULL ELSE greatest(i + 1, k) END AS go FROM nx
), r AS (
  SELECT chunk_id, i, j, scored, go FROM st WHERE i = 0 UNION ALL SELECT st.chunk_id, st.i, st.j, st.scored, st.go FROM r JOIN st ON st.chunk_id = r.chunk_id AND st.i = r.go
), win AS (
  SELECT r.chunk_id, i, j, row_number() OVER (PARTITION BY r.chunk_id ORDER BY i) - 1 AS win_no, array_to_string(a[i + 1:j], ' ') AS text
  FROM r JOIN (SELECT chunk_id, {BLANK_WORDS.format('text')} AS a FROM {source}) USING (chunk_id) WHERE scored
)"""


MATCHES = f"""cand AS (SELECT item_id, chunk_id FROM slots WHERE equal >= 27 UNION SELECT item_id, chunk_id FROM lsh),
wanted AS (SELECT * FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM cand)), {windows('wanted')},
ws AS (SELECT chunk_id, win_no, text, {SHINGLES.format('w')} AS s FROM (SELECT *, {WORDS.format('text')} AS w FROM win)),
ps AS (SELECT item_id, {SHINGLES.format('w')} AS s FROM (SELECT item_id, {WORDS.format('text')} AS w FROM benchmark)),
sco AS (SELECT item_id, chunk_id, win_no, ws.text, len(list_intersect(ps.s, ws.s)) AS x, len(ps.s) + len(ws.s) AS y FROM cand JOIN ps USING (item_id) JOIN ws USING (chunk_id)),
near AS (
  SELECT item_id, chunk_id, x / (y - x)::DOUBLE AS score, text FROM sco WHERE x / (y - x)::DOUBLE >= 0.3
  QUALIFY row_number() OVER (PARTITION BY item_id, chunk_id ORDER BY x / (y - x)::DOUBLE DESC, win_no) = 1
)"""
SHINGLE_ROWS = "SELECT {1}, len(s) AS n, unnest(s) AS shingle FROM (SELECT {1}, " + SHINGLES.format("w") + " AS s FROM (SELECT {1}, " + WORDS.format("{2}") + " AS w FROM {0}))"


def shingle_rows(source: str, key: str, text: str = "text") -> str:
    return f"SELECT {key}, len(s) AS n, unnest(s) AS shingle FROM (SELECT {key}, {SHINGLES.format('w')} AS s FROM (SELECT {key}, {WORDS.format(text)} AS w FROM {source}))"


def escaped(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = f"replace({x}, {lit(a)}, {lit(b)})"
    return x


def highlight(a: str, b: str) -> str:
    key = r"""regexp_replace(lower({0}), '^[.,;:!?"''()\[\]]+|[.,;:!?"''()\[\]]+$', '', 'g')"""
    keys = f"[{key.format('o')} FOR o IN {BLANK_WORDS.format(f'substr({b}, 1, 800)')}]"
    shown = f"CASE WHEN list_contains({keys}, {key.format('v')}) AND length({key.format('v')}) > 2 THEN '<mark>' || {escaped('v')} || '</mark>' ELSE {escaped('v')} END"
    return f"coalesce(array_to_string([{shown} FOR v IN {BLANK_WORDS.format(f'substr({a}, 1, 800)')}], ' '), '')"


def page_text(x: str) -> str:
    x = rf"regexp_replace({x}, '(?is)<script[^>]*>.*?</script>', ' ', 'g')"
    x = rf"regexp_replace({x}, '(?is)<style[^>]*>.*?</style>', ' ', 'g')"
    x = rf"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&")):
        x = f"replace({x}, {lit(a)}, {lit(b)})"
    return rf"trim(regexp_replace(nfc_normalize({x}), '[\s\p{{Z}}\x85]+', ' ', 'g'))"


OG, TITLE = "<meta property=\"og:title\" content=\"([^\"]+)\"", "<title>([^<]+)</title>"
PAGE_TITLE = f"substr(trim(regexp_replace(CASE WHEN regexp_matches(html, {lit(OG)}) THEN {page_text(f'regexp_extract(html, {lit(OG)}, 1)')} WHEN regexp_matches(html, {lit(TITLE)}) THEN {page_text(f'regexp_extract(html, {lit(TITLE)}, 1)')} ELSE '' END, {lit(TITLE_END)}, '')), 1, 200)"


def body(pattern: str) -> str:
    return f"trim(regexp_replace({page_text(f'regexp_extract(html, {lit(pattern)}, 1)')}, {lit(BODY_END)}, ''))"


SITE, ARTICLE = body(r'(?s)<div[^>]*class="[^"]*detail__body-text[^"]*"[^>]*>(.*?)</div>\s*<'), body(r"(?s)<article[^>]*>(.*?)</article>")
SAFE = r"regexp_replace(substr({0}, 1, 60), '[^\p{{L}}\p{{N}}]', '_', 'g')"
ENDINGS = lit(rf"(?i)\.({'|'.join(DOCUMENT_ENDINGS)})$")


def display(x: str) -> str:
    name = rf"CASE WHEN regexp_matches({x}, '(?s)^\d{{10,}}_[^_]+_') THEN regexp_replace({x}, '(?s)^\d{{10,}}_[^_]+_', '') WHEN regexp_matches({x}, '^\d+_') THEN regexp_replace({x}, '^\d+_', '') ELSE {x} END"
    return f"CASE WHEN regexp_replace({name}, {ENDINGS}, '') = '' THEN {x} ELSE regexp_replace({name}, {ENDINGS}, '') END"


def strip(before: str, now: str, pattern: str, flags: str, count: str, condition: str = "") -> str:
    """A step of a chain of subqueries that counts and removes a pattern."""
    p = lit(f"(?{flags})" * bool(flags) + pattern)
    new = f"regexp_replace(t, {p}, '', 'g')"
    new = f"CASE WHEN len(regexp_extract_all(t, {p})) > 2 THEN {new} ELSE t END" if condition else new
    return f"{now} AS (SELECT * REPLACE ({new} AS t){', len(regexp_extract_all(t, ' + p + ')) AS ' + count if count else ''} FROM {before})"


BIBLIO = lit(f"(?im){BIBLIOGRAPHY}")
CITED = f"""WITH s0 AS (SELECT id, text, text AS t, length(text) AS original_chars FROM {rows('cited')}),
{strip('s0', 's1', BLOCK_QUOTE, 'm', 'block_quotes_stripped')},
s2 AS (SELECT * REPLACE (CASE WHEN regexp_matches(t, {BIBLIO}) THEN regexp_replace(regexp_split_to_array(t, {BIBLIO})[1], '[\\s\\p{{Z}}]+$', '') ELSE t END AS t), regexp_matches(t, {BIBLIO}) AS cut FROM s1),
s3 AS (SELECT *, CASE WHEN cut THEN original_chars - length(t) ELSE 0 END AS bibliography_chars_stripped FROM s2),
{strip('s3', 's4', DOUBLE_QUOTE, 's', 'd2')}, {strip('s4', 's5', SINGLE_QUOTE, 's', 'd1')}, {strip('s5', 's6', INLINE, '', 'inline_citations_stripped')},
{strip('s6', 's7', FOOTNOTE, '', 'footnote_refs_stripped')}, {strip('s7', 's8', URL, 'i', 'urls_stripped')}, {strip('s8', 's9', NUMBERED, 'm', '', 'many')},
s10 AS (SELECT *, {TRIMMED.format("regexp_replace(regexp_replace(t, '[ " + chr(92) + "t]{{2,}}', ' ', 'g'), '" + chr(92) + "n{{3,}}', chr(10) || chr(10), 'g')").replace('{{', '{').replace('}}', '}')} AS cleaned FROM s9)
SELECT id, cleaned, round(CASE WHEN original_chars = 0 THEN 0 ELSE (1 - length(cleaned) / original_chars::DOUBLE) * 100 END, 6) AS reduction_pct, original_chars, block_quotes_stripped::BIGINT AS block_quotes_stripped,
  bibliography_chars_stripped, (d1 + d2)::BIGINT AS direct_quotes_stripped, inline_citations_stripped::BIGINT AS inline_citations_stripped, footnote_refs_stripped::BIGINT AS footnote_refs_stripped,
  urls_stripped::BIGINT AS urls_stripped, length(cleaned) AS cleaned_chars FROM s10"""

SEP = "chr(1)"
STYLE = f"""WITH s AS (
  SELECT id, text, CASE WHEN len({WORDS.format('text')}) = 0 THEN [''] ELSE {WORDS.format('text')} END AS w,
    list_filter(string_split(regexp_replace({TRIMMED.format('text')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 5) AS se FROM {rows()}
), t AS (
  SELECT *, [len({BLANK_WORDS.format('v')}) FOR v IN (CASE WHEN len(se) = 0 THEN [text] ELSE se END)] AS lens,
    CASE WHEN len(w) < 3 THEN []::VARCHAR[] ELSE [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)] END AS g, list_histogram(w) AS h FROM s
), u AS (
  SELECT *, list_avg(lens) AS al, len(map_keys(h)) AS types FROM t
), f AS (
  SELECT id, al AS avg_sentence_length, sqrt(list_avg([(x - al) * (x - al) FOR x IN lens])) AS sentence_length_std, types / len(w)::DOUBLE AS vocab_diversity,
    list_sum([length(x) FOR x IN w]) / len(w)::DOUBLE AS avg_word_length, (length(text) - length(translate(text, '.,;:!?"''()', ''))) / greatest(length(text), 1)::DOUBLE AS punctuation_density,
    len(list_filter(map_values(h), lambda c: c = 1)) / types::DOUBLE AS rare_word_ratio, (len(g) - len(list_distinct(g))) / greatest(len(g), 1)::DOUBLE AS ngram_repetition,
    len(list_filter(w, lambda x: x IN {among(BE_VERBS)})) / len(w)::DOUBLE AS passive_voice_estimate, len(list_filter(w, lambda x: x IN {among(HEDGES)})) / len(w)::DOUBLE AS hedging_words_ratio FROM u
)
SELECT id, round(avg_sentence_length, 6) AS avg_sentence_length, round(sentence_length_std, 6) AS sentence_length_std, round(vocab_diversity, 6) AS vocab_diversity, round(avg_word_length, 6) AS avg_word_length,
  round(punctuation_density, 6) AS punctuation_density, round(rare_word_ratio, 6) AS rare_word_ratio, round(ngram_repetition, 6) AS ngram_repetition, round(passive_voice_estimate, 6) AS passive_voice_estimate,
  round(hedging_words_ratio, 6) AS hedging_words_ratio,
  round(greatest(0, least(1, 0.5::DOUBLE + CASE WHEN sentence_length_std < 5 THEN 0.15::DOUBLE WHEN sentence_length_std > 12 THEN -0.15::DOUBLE ELSE 0 END
   + CASE WHEN hedging_words_ratio > 0.04 THEN 0.20::DOUBLE WHEN hedging_words_ratio < 0.005 THEN -0.10::DOUBLE ELSE 0 END + CASE WHEN ngram_repetition > 0.20 THEN 0.10::DOUBLE WHEN ngram_repetition < 0.05 THEN -0.10::DOUBLE ELSE 0 END
   + CASE WHEN rare_word_ratio < 0.35 THEN 0.10::DOUBLE WHEN rare_word_ratio > 0.55 THEN -0.10::DOUBLE ELSE 0 END)), 6) AS style_score FROM f"""

CASES = r"""cases AS (SELECT lang, quality = 1 AS a, len(regexp_extract_all(text, '[#*$%&|]')) < 5 AS d FROM documents JOIN labels USING (doc_id))"""


def confusion(by: str = "") -> str:
    key, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    div = "coalesce({0} / nullif({1}, 0)::DOUBLE, 0)"
    p, r = div.format("tp", "tp + fp"), div.format("tp", "tp + fn")
    return f"""WITH {CASES}, m AS (SELECT {key}count(*) FILTER (a AND d) AS tp, count(*) FILTER (NOT a AND d) AS fp, count(*) FILTER (a AND NOT d) AS fn, count(*) FILTER (NOT a AND NOT d) AS tn FROM cases {group})
SELECT {key}tp, fp, fn, tn, round({p}, 9) AS "precision", round({r}, 9) AS recall, round({div.format('tn', 'tn + fp')}, 9) AS specificity, round({div.format('fp', 'fp + tn')}, 9) AS fpr,
  round({div.format(f'(2 * {p} * {r})', f'({p} + {r})')}, 9) AS f1, round({div.format('(tp + tn)', 'tp + fp + fn + tn')}, 9) AS accuracy FROM m"""


ROUGHLY = " + ".join(f"contains(lower(substr(text, 1, 5000)), {lit(w)})::INT" for w in INDONESIAN_MARKERS)
LOOKS = f"len({WORDS.format('text')}) >= 6 AND len(list_filter({WORDS.format('text')}, lambda x: x IN {among(INDONESIAN_FUNCTION_WORDS)})) / greatest(len({WORDS.format('text')}), 1)::DOUBLE > 0.08"
TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\s\-]', ' ', 'g'), '\s+'), lambda x: x <> '')"
FILE_SOURCE = """CASE WHEN starts_with(name, 'news_') THEN 'news.' || coalesce(string_split(name, '_')[2], '') WHEN starts_with(name, 'arxiv__') THEN 'arxiv' WHEN starts_with(name, 'openalex_') THEN 'openalex'
  WHEN starts_with(name, 'crossref') THEN 'crossref' WHEN starts_with(name, 'local__') THEN 'local' WHEN starts_with(name, 'cc_') OR contains(name, 'commoncrawl') THEN 'commoncrawl' ELSE 'other' END"""
REPORTS = """reports AS (
  SELECT event_id AS report_id, user_id::VARCHAR AS session, CASE WHEN event_id % 17 = 0 THEN '?' ELSE (epoch_us(ts) // 1000)::VARCHAR || '_abcd1234_' || event_type || ' ' || event_id::VARCHAR || '.docx' END AS document_name,
    event_id % 5 AS total_paragraphs, (event_id % 101) / 100::DOUBLE AS overall_score, (event_id % 97)::DOUBLE AS ai_percent, ts AS finished_at FROM events
)"""


def band(x: str, high: str, middle: str, names: tuple[str, str, str], op: str = ">") -> str:
    return f"CASE WHEN {x} {op} {high} THEN {lit(names[0])} WHEN {x} {op} {middle} THEN {lit(names[1])} ELSE {lit(names[2])} END"


def risk(x: str, names=("high", "med", "low")) -> str:
    return band(x, "0.30", "0.10", names)


MONTH = "['Januari', 'Februari', 'Maret', 'April', 'Mei', 'Juni', 'Juli', 'Agustus', 'September', 'Oktober', 'November', 'Desember']"
AGO = "epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(finished_at)"


def cosine_top(name: str, part: str) -> str:
    unit = f"list_transform({part}, lambda x: x::DOUBLE)"
    return f"""{name} AS (
  SELECT a.vec_id AS q, b.vec_id AS c, round(list_dot_product(a.v, b.v), 9) AS cosine FROM (SELECT vec_id, {unit} AS v FROM embeddings) a JOIN (SELECT vec_id, {unit} AS v FROM embeddings) b ON a.vec_id <> b.vec_id
  QUALIFY row_number() OVER (PARTITION BY q ORDER BY cosine DESC, c) = 1
)"""


PERPLEXITY = "CASE WHEN perplexity IS NULL OR isnan(perplexity) OR isinf(perplexity) THEN 0.5::DOUBLE WHEN perplexity < 25 THEN 0.95::DOUBLE WHEN perplexity < 50 THEN 0.75::DOUBLE WHEN perplexity < 100 THEN 0.45::DOUBLE WHEN perplexity < 200 THEN 0.25::DOUBLE ELSE 0.10::DOUBLE END"
META = "trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s){0}', 1), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g'))"
FIRST = "trim(coalesce(regexp_extract_all(html, '(?s){0}', 1)[1], ''))"
EVERY = "[trim(v) FOR v IN regexp_extract_all(html, '{0}', 1)]"
AUTHORS, OTHERS = EVERY.format('<a href="/author/view/\\d+"><xmp>([^<]+)</xmp>'), EVERY.format('<xmp>([A-Z][^<]{2,40})</xmp>\\s*</a>\\s*<span class="author-article-afil"')

ORACLES: dict[str, str] = {
    "shingle_counts": f"SELECT id, len(w)::BIGINT AS n_words, len({BLANK_WORDS.format('text')})::BIGINT AS n_blank_words, len({SHINGLES.format('w')})::BIGINT AS n_shingles FROM (SELECT id, text, {WORDS.format('text')} AS w FROM {rows()})",
    "clean_text": rf"""WITH l AS (SELECT id, list_filter(regexp_split_to_array(text, '\r\n|[\n\x0B\f\r\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: NOT regexp_matches(x, '^\s*\d{{1,4}}\s*$')) AS a FROM {rows()})
SELECT id, {TRIMMED.format("regexp_replace(regexp_replace(coalesce(array_to_string(a, chr(10)), ''), '[ @t]{{2,}}', ' ', 'g'), '@n{{3,}}', chr(10) || chr(10), 'g')").replace('@', chr(92)).replace('{{', '{').replace('}}', '}')} AS cleaned FROM l""",
    "paragraph_split": f"WITH {blocks(BROKEN, 'doc_id')} SELECT doc_id, para_no::BIGINT AS para_no, para FROM paras",
    "sentence_split": rf"""WITH a AS (SELECT id, list_filter([{TRIMMED.format('v')} FOR v IN string_split(regexp_replace(text, '([.!?])\s+([A-Z\d"“])', '\1' || chr(1) || '\2', 'g'), chr(1))], lambda x: length(x) > 15) AS s FROM {rows()})
SELECT id, unnest(range(len(s))) AS sentence_no, unnest(s) AS sentence FROM a""",
    "indonesian_flags": f"SELECT id, {LOOKS} AS looks, {ROUGHLY} >= 4 AS roughly FROM {rows()}",
    "indonesian_preprocess": f"SELECT id, coalesce(array_to_string({TOKENS}, ' '), '') AS tokens, CASE WHEN {LOOKS} THEN array_to_string(list_filter({TOKENS}, lambda x: x NOT IN {among(INDONESIAN_STOPWORDS)}), ' ') ELSE text END AS processed FROM {rows()}",
    "doc_chunks": f"WITH {CHUNKS} SELECT chunk_id, doc_id, chunk_no, text FROM chunks",
    "page_text": f"SELECT page_id, {page_text('html')} AS text FROM pages",
    "page_articles": f"SELECT page_id, {PAGE_TITLE} AS title, CASE WHEN length({SITE}) > 200 THEN {SITE} WHEN length({ARTICLE}) > 200 THEN {ARTICLE} ELSE '' END AS body FROM pages",
    "abstract_lines": f"""WITH d AS (SELECT doc_id, text, 'Title' || chr(10) || 'Authors' || chr(10) || 'Abstract: ' || chr(10) || text AS t FROM documents),
e AS (SELECT doc_id, t, {TRIMMED.format("regexp_extract(t, '(?ms)^Abstract:@s*@n(.*?)$', 1)").replace('@', chr(92))} AS a, {TRIMMED.format('text')} AS plain FROM d)
SELECT doc_id, a AS abstract, CASE WHEN a <> t AND length(a) > 100 THEN a ELSE t END AS rewritten, plain FROM e""",
    "highlighted_pairs": f"SELECT id, {highlight('a', 'b')} AS left_html, {highlight('b', 'a')} AS right_html FROM (SELECT -id AS id, a, b FROM {values('pairs')} UNION ALL SELECT doc_id, d.text, b.text FROM documents d JOIN benchmark b ON doc_id = item_id)",
    "file_names": f"""SELECT id, {SAFE.format('name')} AS safe, {display('name')} AS display,
  CASE WHEN translate(regexp_replace(coalesce(nullif(trim({display('name')}), ''), 'x'), {ENDINGS}, ''), '/\\"', '__''') = '' THEN 'laporan' ELSE translate(regexp_replace(coalesce(nullif(trim({display('name')}), ''), 'x'), {ENDINGS}, ''), '/\\"', '__''') END AS stem,
  CASE WHEN regexp_extract(lower(name), '\\.({'|'.join(UPLOAD_ENDINGS)})$') = '' THEN '.pdf' ELSE regexp_extract(lower(name), '\\.({'|'.join(UPLOAD_ENDINGS)})$') END AS ending FROM {values('names')}""",
    "text_variants": "SELECT doc_id, replace(replace(replace(replace(text, '. ', '. Also, '), ', ', ', in fact, '), ' the ', ' the particular '), ' is ', ' is indeed ') AS light, 'NEAR-COPY TEST' || chr(10) || chr(10) || substr(replace(replace(replace(text, ' the ', ' a '), ' and ', ' & '), ' is ', ' appears to be '), 1, 2000) AS near FROM documents",
    "citation_strip_stats": CITED,
    "citation_sentences": f"SELECT id, t <> '' AND regexp_matches(t, {lit(INLINE)}) AND (length(t) < 200 OR regexp_matches(t, {lit('(?i)' + PHRASE)})) AS cites FROM (SELECT id, {TRIMMED.format('text')} AS t FROM {rows('cited')})",
    "stylometry_features": STYLE,
    "paragraph_verdicts": f"""WITH l AS (SELECT doc_id, unnest(range(len(p))) AS para_no, unnest(p) AS para FROM (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS p FROM documents)),
t AS (SELECT doc_id, para_no, {TRIMMED.format('para')} AS para FROM l), q AS (SELECT *, (length(substr(para, 1, 1000)) % 101) / 101.0::DOUBLE AS p FROM t WHERE length(para) >= 100)
SELECT doc_id, para_no::BIGINT AS para_no, substr(para, 1, 200) || '...' AS text, round(p, 3) AS ai_probability, CASE WHEN p > 0.8 THEN 'AI-LIKELY' WHEN p > 0.5 THEN 'MIXED' ELSE 'HUMAN' END AS verdict FROM q""",
    "machine_text_verdicts": f"""WITH b AS (SELECT *, 0.70::DOUBLE * p + 0.15::DOUBLE * CASE WHEN n_words > 50 THEN {PERPLEXITY} ELSE p END + 0.15::DOUBLE * CASE WHEN n_words > 100 THEN style ELSE p END AS x FROM {values('probabilities')})
SELECT id, round(x, 6) AS blend, {band('x', '0.70', '0.45', ('AI-LIKELY', 'MIXED', 'HUMAN'))} AS verdict, CASE WHEN x > 0.85 OR 1 - x > 0.85 THEN 'high' ELSE 'medium' END AS confidence,
  {band('p', '0.8', '0.5', ('AI-LIKELY', 'MIXED', 'HUMAN'))} AS plain_verdict, CASE WHEN p > 0.95 OR 1 - p > 0.95 THEN 'high' ELSE 'medium' END AS plain_confidence FROM b""",
    "minhash_signatures": f"WITH {signature('documents', 'doc_id', 'sd')} SELECT doc_id, string_agg(m::VARCHAR, ',' ORDER BY slot) AS signature FROM sd GROUP BY doc_id",
    "lsh_candidates": f"WITH {SIGNED} SELECT item_id, chunk_id, coalesce(equal, 0) / 128::DOUBLE AS estimate FROM lsh LEFT JOIN slots USING (item_id, chunk_id)",
    "slot_candidates": f"WITH {SIGNED} SELECT item_id, chunk_id, equal FROM slots WHERE equal >= 27",
    "near_duplicate_pairs": f"WITH s AS ({shingle_rows('documents', 'doc_id')}) SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, round(count(*) / (any_value(a.n) + any_value(b.n) - count(*))::DOUBLE, 9) AS jaccard FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*))::DOUBLE >= 0.3",
    "exact_duplicates": "SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1",
    "chunk_windows": f"WITH RECURSIVE {CHUNKS}, {windows('chunks')} SELECT chunk_id, win_no, i AS first, j AS last, md5(text) AS window_md5 FROM win",
    "benchmark_windowed_match": f"WITH RECURSIVE {SIGNED}, {MATCHES} SELECT item_id, chunk_id, round(score, 9) AS score, CASE WHEN score >= 0.9 THEN 'exact' ELSE 'near' END AS kind, md5(text) AS window_md5 FROM near QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) = 1",
    "semantic_fallback": f"WITH RECURSIVE {SIGNED}, {MATCHES} SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM near)",
    "document_score": f"""WITH {blocks(BROKEN, 'doc_id')}, pk AS (SELECT doc_id * 1000000 + para_no AS para_id, para FROM paras), x AS ({shingle_rows('pk', 'para_id', 'para')}), y AS ({shingle_rows('benchmark', 'item_id')}),
j AS (SELECT para_id, item_id, count(*) / (any_value(x.n) + any_value(y.n) - count(*))::DOUBLE AS s FROM x JOIN y USING (shingle) GROUP BY 1, 2),
m AS (SELECT (para_id // 1000000)::BIGINT AS doc_id, s FROM j WHERE s >= 0.3 QUALIFY row_number() OVER (PARTITION BY para_id ORDER BY s DESC, item_id) = 1),
z AS (SELECT doc_id, coalesce(t, 0) AS total_paragraphs, coalesce(f, 0) AS flagged_paragraphs, coalesce(o, 0) AS o FROM documents LEFT JOIN (SELECT doc_id, count(*) AS t FROM paras GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS f, avg(s) AS o FROM m GROUP BY 1) USING (doc_id))
SELECT doc_id, total_paragraphs, flagged_paragraphs, round(o, 9) AS overall_score, {risk('o', ('TINGGI', 'SEDANG', 'RENDAH'))} AS risk_label, {risk('o')} AS risk_class, flagged_paragraphs > 0 AND o > 0.05 AS suite_flag, o >= 0.30 OR flagged_paragraphs > 0 AS measured_flag, o > 0.30 AS comparison_flag FROM z""",
    "embedding_top1": f"WITH {cosine_top('t', 'embedding')} SELECT q, round(cosine, 5) AS cosine, cosine >= 0.75 AS semantic FROM t",
    "embedding_ensemble": f"""WITH {cosine_top('t0', 'embedding')}, {cosine_top('t1', 'embedding[1:32]')}, {cosine_top('t2', 'embedding[33:64]')}, v AS (SELECT *, 0 AS k FROM t0 UNION ALL SELECT *, 1 FROM t1 UNION ALL SELECT *, 2 FROM t2)
SELECT q, c, count(*) AS votes, round(avg(cosine), 5) AS score FROM v GROUP BY q, c QUALIFY row_number() OVER (PARTITION BY q ORDER BY count(*) DESC, min(k)) = 1""",
    "rerank": f"""SELECT para, CASE WHEN kind = 'exact' OR logit IS NULL THEN kind ELSE 'cross-encoder' END AS kind, round(CASE WHEN kind = 'exact' OR logit IS NULL THEN score ELSE 1 / (1 + exp(-logit)) END, 9) AS score
FROM {values('logits')} WHERE kind = 'exact' OR logit IS NULL OR 1 / (1 + exp(-logit)) >= 0.5""",
    "confusion_matrix": confusion(),
    "confusion_by_language": confusion("lang"),
    "corpus_stats": f"SELECT source, count(*) AS n, sum(len({WORDS.format('text')}))::BIGINT AS words, sum(strlen(text))::BIGINT AS bytes, count(*) FILTER ({ROUGHLY} >= 4) AS indonesian, round(100 * count(*) / (sum(count(*)) OVER ())::DOUBLE, 9) AS percent, (sum(len({WORDS.format('text')})) // count(*))::BIGINT AS avg_words FROM documents GROUP BY source",
    "file_sources": f"SELECT {FILE_SOURCE} AS source, count(*) AS n, round(100 * count(*) / (sum(count(*)) OVER ())::DOUBLE, 9) AS percent FROM {values('files')} GROUP BY 1",
    "term_stats": f"WITH t AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS w FROM documents) GROUP BY ALL) SELECT doc_id, sum(c)::BIGINT AS words, count(*) AS types, count(*) FILTER (c = 1) AS hapaxes, max(c) AS most FROM t GROUP BY doc_id",
    "first_wins_union": f"SELECT doc_id, title, query_no, source_no FROM {values('listing')} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY query_no, source_no, place) = 1",
    "append_documents": "SELECT length(text) AS chars, count(*) AS n FROM (SELECT text FROM documents UNION ALL SELECT 'A seeded document. A seeded document.' FROM range(2)) GROUP BY 1",
    "shingle_sets": f"WITH s AS (SELECT item_id, {SHINGLES.format('w')} AS a, {SHINGLES.format('v')} AS b FROM (SELECT item_id, {WORDS.format('b.text')} AS w, {WORDS.format('d.text')} AS v FROM benchmark b JOIN documents d ON item_id = doc_id)) SELECT item_id, len(list_intersect(a, b))::BIGINT AS common, len(list_distinct(list_concat(a, b)))::BIGINT AS all_of_both FROM s",
    "link_list": f"SELECT link, min(place) AS place FROM {values('links')} WHERE NOT regexp_matches(link, {lit(NO_ARTICLE)}) GROUP BY link",
    "round_robin": f"SELECT subject, journal, row_number() OVER (PARTITION BY subject ORDER BY place) AS turn FROM {values('journals')}",
    "not_collected": "SELECT page_id, substr(md5(url), 1, 10) AS key FROM pages WHERE substr(md5(url), 1, 10) NOT IN (SELECT substr(md5(url), 1, 10) FROM pages WHERE page_id % 3 = 0)",
    "cache_delta": "SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN label ELSE label + 1000 END::BIGINT AS value FROM embeddings",
    "cache_keys": f"WITH {CHUNKS} SELECT chunk_id, sha256(chunk_id::VARCHAR || chr(10) || text) AS key FROM chunks",
    "recent_reports": f"WITH {REPORTS} SELECT report_id, document_name, overall_score, finished_at FROM reports WHERE session = '7' AND document_name NOT IN ('', '?') AND total_paragraphs > 0 ORDER BY finished_at DESC, report_id LIMIT 20",
    "report_lookup": f"WITH {REPORTS} SELECT report_id, session FROM reports WHERE report_id = 42 UNION ALL SELECT report_id, session FROM reports WHERE report_id = 42 AND session = '7'",
    "enriched_reports": f"""WITH {REPORTS} SELECT report_id, {display('document_name')} AS display, {risk('overall_score', ('TINGGI', 'SEDANG', 'RENDAH'))} AS label, {risk('overall_score')} AS risk, {band('overall_score', '0.70', '0.40', ('high', 'med', 'low'))} AS match,
  {band('ai_percent', '60', '30', ('ai-high', 'ai-med', 'ai-low'))} AS ai, {band('overall_score * 100', '50', '20', ('hi', 'mid', 'lo'), '>=')} AS document_band, {band('overall_score * 100', '70', '40', ('hi', 'mid', 'lo'), '>=')} AS match_band,
  day(finished_at)::VARCHAR || ' ' || {MONTH}[month(finished_at)] || ' ' || year(finished_at)::VARCHAR || ', ' || strftime(finished_at, '%H:%M') AS finished,
  CASE WHEN floor({AGO}) < 60 THEN floor({AGO})::BIGINT::VARCHAR || ' detik' WHEN floor({AGO}) < 3600 THEN (floor({AGO})::BIGINT // 60)::VARCHAR || ' menit' WHEN floor({AGO}) < 86400 THEN (floor({AGO})::BIGINT // 3600)::VARCHAR || ' jam' ELSE (floor({AGO})::BIGINT // 86400)::VARCHAR || ' hari' END || ' lalu' AS ago FROM reports""",
    "history_search": f"WITH {REPORTS} SELECT report_id, document_name, overall_score FROM reports WHERE contains(lower(document_name), 'click') AND overall_score > 0.30",
    "history_machine_text": f"WITH {REPORTS} SELECT report_id, ai_percent FROM reports WHERE ai_percent > 60",
    "report_retention": rf"WITH {REPORTS}, e AS (SELECT document_name, coalesce(TRY_CAST(nullif(regexp_extract(document_name, '^(\d+)_', 1), '') AS BIGINT) < 1706745600000 - 10 * 86400000, false) AS expired FROM reports) SELECT expired, count(*) AS files, sum(length(document_name))::BIGINT AS bytes, round(sum(length(document_name)) / 1048576::DOUBLE, 6) AS mb FROM e GROUP BY expired",
    "session_ids": rf"SELECT sid, regexp_full_match(sid, '[\p{{L}}\p{{N}}_-]{{16,128}}') AS ok, substr(regexp_replace(sid, '[^\p{{L}}\p{{N}}]', '', 'g'), 1, 8) AS prefix FROM {values('sessions')}",
    "ranked_matches": f"""WITH s AS ({shingle_rows('documents', 'doc_id')}), j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*))::DOUBLE AS s FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2)
SELECT a, b, round(s, 9) AS score, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rank FROM j WHERE s >= 0.3 QUALIFY rank <= 3""",
    "semantic_scholar_rows": f"""WITH x AS (SELECT unnest(from_json(payload->'data', '[{{"paperId":"VARCHAR","title":"VARCHAR","abstract":"VARCHAR","url":"VARCHAR","year":"BIGINT"}}]')) AS x FROM {values('scholar')})
SELECT 's2:' || x.paperId AS doc_id, coalesce(x.title, '') AS title, x.abstract AS text, 'semantic_scholar' AS source, coalesce(x.url, '') AS url, x.year AS year FROM x WHERE coalesce(x.abstract, '') <> ''""",
    "open_alex_rows": f"""WITH x AS (SELECT unnest((payload->'results')::JSON[]) AS x FROM {values('alex')}), w AS (SELECT x, unnest(json_keys(x->'abstract_inverted_index')) AS k FROM x),
p AS (SELECT x, k, unnest((x->'abstract_inverted_index'->k)::BIGINT[]) AS pos FROM w), t AS (SELECT x, string_agg(k, ' ' ORDER BY pos, k) AS a FROM p GROUP BY x)
SELECT 'openalex:' || regexp_extract(x->>'id', '([^/]+)$', 1) AS doc_id, x->>'title' AS title, (x->>'title') || chr(10) || chr(10) || 'Authors: ' || array_to_string([v->'author'->>'display_name' FOR v IN ((x->'authorships')::JSON[])[1:5]], ', ') || chr(10) || 'Year: ' || (x->>'publication_year') || chr(10) || chr(10) || a AS text, 'openalex' AS source, x->>'doi' AS url FROM t""",
    "crossref_rows": f"""WITH x AS (SELECT unnest((payload->'message'->'items')::JSON[]) AS x FROM {values('cross')}), a AS (SELECT x, trim(regexp_replace(x->>'abstract', '<[^>]+>', ' ', 'g')) AS a, coalesce(x->'title'->>0, '(untitled)') AS t FROM x)
SELECT 'crossref:' || (x->>'DOI') AS doc_id, t AS title, t || chr(10) || chr(10) || a AS text, 'crossref' AS source, coalesce(x->>'URL', '') AS url, (x->'issued'->'date-parts'->0->>0)::BIGINT AS year FROM a WHERE length(a) >= 100""",
    "abstract_service_rows": f"""WITH x AS (SELECT unnest(coalesce(payload->'data', payload->'docs', payload->'results')::JSON[]) AS x FROM {values('abstracts')}), a AS (SELECT x, coalesce(nullif(x->>'abstract', ''), nullif(x->>'abstrak', ''), nullif(x->>'description', '')) AS a FROM x)
SELECT 'garuda:' || (x->>'id') AS doc_id, x->>'title' AS title, a AS text, 'garuda' AS source, coalesce(x->>'url', '') AS url FROM a WHERE length(a) >= 50""",
    "sitemap_links": rf"WITH l AS (SELECT regexp_extract_all(regexp_replace(xml, '(?s)<!\[CDATA\[(.*?)\]\]>', '\1', 'g'), '<loc>\s*([^<]+?)\s*</loc>', 1) AS a FROM {values('sitemaps')}) SELECT unnest(a) AS link, ends_with(unnest(a), '.xml') AS is_sitemap, unnest(range(len(a))) AS place FROM l",
    "journal_articles": f"""SELECT id, CASE WHEN {META.format('<xmp>([^<]+)</xmp>@s*</h3>').replace('@', chr(92))} <> '' THEN {META.format('<xmp>([^<]+)</xmp>@s*</h3>').replace('@', chr(92))} ELSE {FIRST.format('<h3[^>]*>@s*<xmp>([^<]+)</xmp>').replace('@', chr(92))} END AS title,
  array_to_string(CASE WHEN len({AUTHORS}) > 0 THEN {AUTHORS} ELSE {OTHERS} END, '|') AS authors, {META.format('<xmp class="abstract-article">([^<]+)</xmp>')} AS abstract, {META.format('<a href="/journal/view/@d+"@s*><xmp>([^<]+)</xmp>').replace('@', chr(92))} AS journal,
  {FIRST.format('<xmp>(Vol[^<]*)</xmp>')} AS volume_issue, {FIRST.format('Publish Date@s*</h4>@s*<p>([^<]+)</p>').replace('@', chr(92))} AS publish_date, {FIRST.format('<a class="ui tag label[^"]*" href="/area/index/@d+">([^<]+)</a>').replace('@', chr(92))} AS subject,
  coalesce(array_to_string(list_sort(list_distinct([v::BIGINT FOR v IN regexp_extract_all(html, 'href="/journal/view/(\\d+)"', 1)])), ','), '') AS journals FROM {values('journal_pages')}""",
    "upload_checks": f"""WITH k AS (SELECT *, lower(regexp_extract(name, '\\.([^./]+)$', 1)) AS kind FROM {values('uploads')}) SELECT name, length, CASE WHEN kind NOT IN ('pdf', 'docx', 'txt') THEN 'kind' WHEN length > 10485760 THEN 'size' WHEN kind = 'pdf' AND NOT starts_with(head, '%PDF-') OR kind = 'docx' AND NOT starts_with(head, 'PK' || chr(3) || chr(4)) THEN 'content' END AS problem FROM k""",
    "stored_names": f"""WITH t AS (SELECT page_id, url, {PAGE_TITLE} AS t FROM pages) SELECT page_id, 'arxiv__' || {SAFE.format('t')} || '.txt' AS document, 'garuda__Law___Order__' || {SAFE.format('t')} || '_' || substr(md5(page_id::VARCHAR || '-' || t), 1, 10) || '.txt' AS abstract,
  'news_detik_' || substr(md5(url), 1, 10) || '.txt' AS news, t || chr(10) || chr(10) || 'body' || chr(10) || chr(10) || 'Source: ' || url || chr(10) AS content FROM t""",
}
