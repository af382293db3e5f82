"""Text cleaning, segmentation and tokenising as column expressions.

Regular expressions are written for Java with ``(?d)`` where ``.``, ``^`` or ``$`` matter,
so that only ``\\n`` ends a line, and use explicit classes instead of ``\\w``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.pages import decoded

WORD = r"[\p{L}\p{N}_]+"
LINE_END = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\x{2028}\x{2029}]"

# Function words that mark a text as Indonesian.
INDONESIAN_FUNCTION_WORDS = """
yang dan di ini itu dengan untuk tidak pada juga dari ada sudah telah oleh ke
akan adalah sebagai antara ia dia mereka kita kami saya kamu tapi tetapi namun
atau bila jika kalau ketika saat waktu banyak sedikit semua setiap bisa dapat harus
perlu sangat amat sekali pernah selalu sering menurut bahwa yaitu yakni
kepada terhadap mengenai tentang dalam luar atas bawah depan belakang sebelum sesudah
setelah dimana kapan bagaimana mengapa siapa apa seperti mirip hampir nyaris
lagi masih sedang belum
""".split()

# Words whose presence as substrings marks a corpus file as Indonesian.
INDONESIAN_MARKERS = ["yang", "dan", "di", "ini", "itu", "dengan", "untuk", "tidak"]

# Function words that are left out of Indonesian academic text. A longer list is a parameter.
INDONESIAN_STOPWORDS = """
yang dan di ini itu dengan untuk tidak pada juga dari ada sudah telah oleh ke
bisa akan saya kamu mereka kami kita beliau ia dia engkau anda kau
harus dapat perlu banyak sedikit semua sebagian selain walaupun meskipun biarpun sekalipun
sebab karena akibat kalau jika bila apabila bilamana kapan dimana kemana darimana bagaimana
mengapa kenapa apa siapa siapakah manakah tapi tetapi namun sedangkan sementara sebaliknya
yakni yaitu umumnya biasanya sering jarang kadangkala kadang amat sangat sekali agak lagi
masih belum bukan pernah selalu kerap acap menurut yakin pasti tentu memang
bahkan bahwa bahwasanya biar
""".split()


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is named, also in the body's own lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def trimmed(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def clean_lines(text: Column) -> Column:
    """Drop lines that are page numbers, collapse blanks and blank lines, trim."""
    lines = F.filter(F.split(text, LINE_END), lambda x: ~x.rlike(r"^\s*\d{1,4}\s*$"))
    out = F.regexp_replace(F.array_join(lines, "\n"), r"[ \t]{2,}", " ")
    return trimmed(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def blank_words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"[\s\p{Z}]+"), lambda x: x != "")


def shingles(tokens: Column, k: int = 3) -> Column:
    """Distinct runs of k words; all words as one run if there are fewer; none if there are none."""
    runs = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, k), " "))
    return bound(tokens, lambda w: F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs(w))))


def sentences(text: Column, min_chars: int = 15) -> Column:
    """Cut after .!? before a capital, digit or quotation mark; sentences of more than ``min_chars`` characters."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z\d\"“])"), trimmed)
    return F.filter(parts, lambda x: F.length(x) > min_chars)


def looks_indonesian(text: Column) -> Column:
    hits = lambda ws: F.size(F.filter(ws, lambda w: w.isin(INDONESIAN_FUNCTION_WORDS)))
    return bound(words(text), lambda ws: (F.size(ws) >= 6) & (hits(ws) / F.greatest(F.size(ws), F.lit(1)) > 0.08))


def roughly_indonesian(text: Column) -> Column:
    head = F.lower(F.substring(text, 1, 5000))
    return sum((F.contains(head, F.lit(w)).cast("int") for w in INDONESIAN_MARKERS), F.lit(0)) >= 4


def indonesian_tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s\-]", " "), r"\s+"), lambda x: x != "")


def without_stopwords(tokens: Column, stopwords: Sequence[str] = INDONESIAN_STOPWORDS) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(list(stopwords)))


def preprocess_indonesian(text: Column, stopwords: Sequence[str] = INDONESIAN_STOPWORDS, stemmer=None) -> Column:
    """Indonesian text without stop words, stemmed where a ``stemmer`` (array column to array column) is given; other text as it is."""
    tokens = without_stopwords(indonesian_tokens(text), stopwords)
    tokens = stemmer(tokens) if stemmer else tokens
    return F.when(looks_indonesian(text), F.array_join(tokens, " ")).otherwise(text)


def char_chunks(text: Column, size: int = 1500, stride: int = 1300) -> Column:
    """The text itself up to ``size`` characters, else windows of that size every ``stride`` characters."""
    windows = F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(stride)), lambda s: F.substring(text, s + 1, F.lit(size)))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(windows)


def html_text(html: Column) -> Column:
    """Scripts and styles out, tags to blanks, character references decoded and composed, white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " ")
    out = F.regexp_replace(out, r"(?is)<style[^>]*>.*?</style>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(decoded(out), r"[\s\p{Z}\x85]+", " "))


def abstract_line(text: Column) -> Column:
    """The line below ``Abstract:``, else the text; trimmed."""
    header = r"(?md)^Abstract:\s*\n(.*?)$"
    return trimmed(F.when(text.rlike(header), F.regexp_extract(text, header, 1)).otherwise(text))


def rewritten_abstract(text: Column) -> Column:
    """What an abstract file is rewritten to: the abstract if that differs and has over 100 characters."""
    out = abstract_line(text)
    return F.when((out != text) & (F.length(out) > 100), out).otherwise(text)


def escape_html(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def highlighted(text: Column, other: Column, chars: int = 800) -> Column:
    """Words of ``text`` in HTML; those that ``other`` has too (case and end punctuation aside, over two characters) are marked."""
    key = lambda w: F.regexp_replace(F.lower(w), r"""^[.,;:!?"'()\[\]]+|[.,;:!?"'()\[\]]+$""", "")
    keys = F.transform(blank_words(F.substring(other, 1, chars)), key)
    shown = lambda keys, w: F.when(F.array_contains(keys, key(w)) & (F.length(key(w)) > 2), F.concat(F.lit("<mark>"), escape_html(w), F.lit("</mark>"))).otherwise(escape_html(w))
    return bound(keys, lambda ks: F.array_join(F.transform(blank_words(F.substring(text, 1, chars)), lambda w: shown(ks, w)), " "))


def safe_title(title: Column, chars: int = 60) -> Column:
    return F.regexp_replace(F.substring(title, 1, chars), r"[^\p{L}\p{N}]", "_")


# Endings that display names lose, and those that uploads may keep.
DOCUMENT_ENDINGS = ["txt", "docx", "doc", "pdf", "md", "rtf", "json", "jsonl", "csv", "xlsx", "xls", "odt", "pages"]
UPLOAD_ENDINGS = ["pdf", "docx", "txt", "doc", "md", "rtf"]


def display_name(raw: Column) -> Column:
    """Without the time and session that stored names start with, and without a document ending."""
    name = F.when(raw.rlike(r"(?s)^\d{10,}_[^_]+_"), F.regexp_replace(raw, r"(?s)^\d{10,}_[^_]+_", "")).when(raw.rlike(r"^\d+_"), F.regexp_replace(raw, r"^\d+_", "")).otherwise(raw)
    cut = F.regexp_replace(name, rf"(?i)\.({'|'.join(DOCUMENT_ENDINGS)})$", "")
    return F.when(cut == "", raw).otherwise(cut)


def download_stem(display: Column, fallback: Column) -> Column:
    name = F.coalesce(F.nullif(F.trim(display), F.lit("")), fallback)
    name = F.regexp_replace(name, rf"(?i)\.({'|'.join(DOCUMENT_ENDINGS)})$", "")
    name = F.translate(name, "/\\\"\n\r", "__'  ")
    return F.when(name == "", "laporan").otherwise(name)


def safe_ending(name: Column) -> Column:
    found = F.regexp_extract(F.lower(name), rf"\.({'|'.join(UPLOAD_ENDINGS)})$", 0)
    return F.when(found == "", ".pdf").otherwise(found)


def light_modified(text: Column) -> Column:
    for a, b in ((". ", ". Also, "), (", ", ", in fact, "), (" the ", " the particular "), (" is ", " is indeed ")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def near_copy(text: Column, chars: int = 2000) -> Column:
    for a, b in ((" the ", " a "), (" and ", " & "), (" is ", " appears to be ")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.concat(F.lit("NEAR-COPY TEST\n\n"), F.substring(text, 1, chars))


# Synonyms for light paraphrases.
SYNONYMS = {
    "study": "research", "research": "study", "result": "outcome", "show": "demonstrate", "demonstrate": "show",
    "use": "utilize", "utilize": "employ", "method": "approach", "approach": "method", "analysis": "examination",
    "data": "information", "system": "framework", "framework": "system", "application": "app", "model": "scheme",
    "process": "procedure", "important": "crucial", "therefore": "thus", "however": "nevertheless", "also": "additionally",
    "because": "since", "many": "numerous", "showed": "revealed", "found": "discovered", "very": "highly", "large": "substantial",
}


def paraphrased(text: Column, seed: int = 42) -> Column:
    """Some neighbouring sentences swapped and some words replaced, each with probability 0.3 by a hash of its place and text."""
    chance = lambda *x: F.pmod(F.xxhash64(F.lit(seed), *x), F.lit(10)) < 3
    cut = F.filter(F.transform(F.split(text, r"[.;] "), lambda x: F.trim(x)), lambda x: x != "")
    partner = lambda i: F.when(i % 2 == 0, i + 1).otherwise(i - 1)
    swapped = lambda ps, i: (F.size(ps) > 2) & F.get(ps, partner(i)).isNotNull() & chance(F.floor(i / 2), F.length(text))
    parts = bound(cut, lambda ps: F.transform(ps, lambda x, i: F.when(swapped(ps, i), F.get(ps, partner(i))).otherwise(x)))
    table = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    key = lambda w: F.btrim(F.lower(w), F.lit(".,;:"))
    out = F.transform(blank_words(F.array_join(parts, ". ")), lambda w, i: F.when(chance(i, w), F.coalesce(F.try_element_at(table, key(w)), w)).otherwise(w))
    return F.array_join(out, " ")


def split_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, fallback: bool = False) -> DataFrame:
    """(id, para_no, para). Blocks between blank lines of ``min_chars`` or more start a paragraph; shorter ones join
    the one before, or are dropped where there is none. ``fallback``: a text without paragraphs is one, if not blank."""
    blocks = docs.select(id_col, F.posexplode(F.split(text_col, "\n\n")).alias("_pos", "_block")).withColumn("_block", trimmed(F.col("_block"))).where("_block <> ''")
    started = F.sum((F.length("_block") >= min_chars).cast("int")).over(Window.partitionBy(id_col).orderBy("_pos"))
    groups = blocks.withColumn("para_no", started).where("para_no > 0").groupBy(id_col, "para_no")
    paras = groups.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_block"))), lambda x: x["_block"]), " ").alias("para"))
    paras = paras.select(id_col, (F.col("para_no") - 1).alias("para_no"), "para")
    if not fallback:
        return paras
    rest = docs.join(paras.select(id_col).distinct(), id_col, "left_anti").where(trimmed(F.col(text_col)) != "")
    return paras.unionByName(rest.select(id_col, F.lit(0).cast("long").alias("para_no"), F.col(text_col).alias("para")))
