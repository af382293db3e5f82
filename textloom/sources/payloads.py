"""Payloads of literature services to document rows, sitemaps to links, and pages to articles. Nothing is fetched here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import html_text

#: Columns that every payload is brought to.


def _filled(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def semantic_scholar(payloads: DataFrame, col: str = "payload") -> DataFrame:
    schema = "data array<struct<paperId:string,title:string,abstract:string,url:string,year:int>>"
    d = payloads.select(F.explode(F.from_json(col, schema)["data"]).alias("x")).where(_filled(F.col("x.abstract")) != "")
    return d.select(F.concat(F.lit("s2:"), F.col("x.paperId")).alias("doc_id"), _filled(F.col("x.title")).alias("title"), F.col("x.abstract").alias("text"), F.lit("semantic_scholar").alias("source"), _filled(F.col("x.url")).alias("url"), F.col("x.year").alias("year"))


def inverted_abstract(index: Column) -> Column:
    """A map from words to their places, back to text: by place, then word."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def open_alex(payloads: DataFrame, col: str = "payload") -> DataFrame:
    schema = "results array<struct<id:string,title:string,publication_year:int,doi:string,authorships:array<struct<author:struct<display_name:string>>>,abstract_inverted_index:map<string,array<int>>>>"
    d = payloads.select(F.explode(F.from_json(col, schema)["results"]).alias("x")).where(F.col("x.abstract_inverted_index").isNotNull())
    abstract = inverted_abstract(F.col("x.abstract_inverted_index"))
    authors = F.array_join(F.transform(F.slice("x.authorships", 1, 5), lambda a: a["author"]["display_name"]), ", ")
    text = F.concat(_filled(F.col("x.title")), F.lit("\n\nAuthors: "), _filled(authors), F.lit("\nYear: "), _filled(F.col("x.publication_year").cast("string")), F.lit("\n\n"), abstract)
    return d.where(abstract != "").select(F.concat(F.lit("openalex:"), F.regexp_extract("x.id", r"([^/]+)$", 1)).alias("doc_id"), _filled(F.col("x.title")).alias("title"), text.alias("text"), F.lit("openalex").alias("source"), _filled(F.col("x.doi")).alias("url"))


def crossref(payloads: DataFrame, col: str = "payload") -> DataFrame:
    schema = "message struct<items:array<struct<DOI:string,title:array<string>,abstract:string,URL:string,issued:struct<`date-parts`:array<array<int>>>>>>"
    d = payloads.select(F.explode(F.from_json(col, schema)["message"]["items"]).alias("x"))
    d = d.withColumn("abstract", F.trim(F.regexp_replace(_filled(F.col("x.abstract")), r"<[^>]+>", " "))).where(F.length("abstract") >= 100)
    title = F.coalesce(F.get("x.title", 0), F.lit("(untitled)"))
    year = F.get(F.get(F.col("x.issued.date-parts"), 0), 0)
    return d.select(F.concat(F.lit("crossref:"), F.col("x.DOI")).alias("doc_id"), title.alias("title"), F.concat(title, F.lit("\n\n"), F.col("abstract")).alias("text"), F.lit("crossref").alias("source"), _filled(F.col("x.URL")).alias("url"), year.alias("year"))


def abstracts_service(payloads: DataFrame, col: str = "payload") -> DataFrame:
    """Items under data, docs or results; the first non-empty of abstract, abstrak and description, of 50 characters or more."""
    item = "array<struct<id:string,title:string,abstract:string,abstrak:string,description:string,url:string>>"
    parsed = F.from_json(col, f"data {item}, docs {item}, results {item}")
    d = payloads.select(F.explode(F.coalesce(parsed["data"], parsed["docs"], parsed["results"])).alias("x"))
    text = F.coalesce(*[F.nullif(F.col(f"x.{c}"), F.lit("")) for c in ("abstract", "abstrak", "description")])
    return d.where(F.length(text) >= 50).select(F.concat(F.lit("garuda:"), F.col("x.id")).alias("doc_id"), _filled(F.col("x.title")).alias("title"), text.alias("text"), F.lit("garuda").alias("source"), _filled(F.col("x.url")).alias("url"))


def atom_entries(payloads: DataFrame, col: str = "payload", need_title: bool = False, with_title: bool = False) -> DataFrame:
    """Entries of an Atom feed with a summary (and title)."""
    schema = "entry array<struct<id:string,title:string,summary:string>>"
    parsed = F.from_xml(F.regexp_replace(col, r'\sxmlns="[^"]*"', ""), schema)
    tidy = lambda x: F.trim(F.regexp_replace(_filled(x), r"\s+", " "))
    d = payloads.select(F.explode(parsed["entry"]).alias("x")).select(F.trim("x.id").alias("url"), tidy(F.col("x.title")).alias("title"), tidy(F.col("x.summary")).alias("summary"))
    d = d.where((F.col("summary") != "") & ((F.col("title") != "") if need_title else F.lit(True)))
    text = F.concat(F.col("title"), F.lit("\n\n"), F.col("summary")) if with_title else F.col("summary")
    return d.select(F.concat(F.lit("arxiv:"), F.regexp_extract("url", r"([^/]+)$", 1)).alias("doc_id"), "title", text.alias("text"), F.lit("arxiv").alias("source"), "url")


def sitemap_links(sitemaps: DataFrame, col: str = "xml") -> DataFrame:
    """(link, is_sitemap, place)."""
    plain = F.regexp_replace(col, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    found = F.regexp_extract_all(plain, F.lit(r"<loc>\s*([^<]+?)\s*</loc>"), 1)
    return sitemaps.select(F.posexplode(found).alias("place", "link")).select("link", F.endswith("link", F.lit(".xml")).alias("is_sitemap"), "place")


# Paths that are not articles.
NO_ARTICLE = r"/(video|foto|infografis|gallery|suara-pembaca|kolom|prokontra|quiz|kuis|podcast|live)/|/read/\d+/\d+/\d+$"


def article_links(links: DataFrame, link: str = "link", place: str = "place") -> DataFrame:
    """Each article link once, with its first place."""
    return links.where(~F.col(link).rlike(NO_ARTICLE)).groupBy(link).agg(F.min(place).alias(place))


# Classes that hold article bodies by site, what ends a body, and endings of titles.
BODY_CLASSES = {"detik": "detail__body-text", "kompas": "read__content", "cnn": "detail__body-text", "liputan6": "article-content-body", "tribun": "txt-article"}
BODY_END = (
    r"(?i)(ADVERTISEMENT|SCROLL TO CONTINUE|googletag\.cmd\.push|Baca juga:|Baca juga |Simak Video|Advertisement continue reading|"
    r"Baca :|Lihat juga|Artikel ini telah tayang|Artikel ini telah terbit|Simak juga|RELATED:.+)$"
)
TITLE_END = r"(?i)\s*[-|]\s*(Detik|Kompas|CNN Indonesia|Liputan6|Tribun)\s*$"


def article_body(html: Column, site: str = "detik") -> Column:
    """The first of the site's own pattern and <article> whose text has over 200 characters; else empty."""
    patterns = [rf'(?s)<div[^>]*class="[^"]*{BODY_CLASSES[site]}[^"]*"[^>]*>(.*?)</div>\s*<', r"(?s)<article[^>]*>(.*?)</article>"]
    found = [F.trim(F.regexp_replace(html_text(F.regexp_extract(html, p, 1)), BODY_END, "")) for p in patterns]
    return F.coalesce(*[F.when(F.length(x) > 200, x) for x in found], F.lit(""))


def article_title(html: Column) -> Column:
    patterns = [r'<meta property="og:title" content="([^"]+)"', r"<title>([^<]+)</title>"]
    found = [F.when(html.rlike(p), html_text(F.regexp_extract(html, p, 1))) for p in patterns]
    return F.substring(F.trim(F.regexp_replace(F.coalesce(*found, F.lit("")), TITLE_END, "")), 1, 200)


def article_metadata(html: Column) -> Column:
    """Struct of what a journal article's page tells."""
    text = lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(html, f"(?s){p}", 1), r"<[^>]+>", ""), r"\s+", " "))
    first = lambda p: F.trim(F.coalesce(F.get(F.regexp_extract_all(html, F.lit(f"(?s){p}"), 1), 0), F.lit("")))
    every = lambda p: F.transform(F.regexp_extract_all(html, F.lit(p), 1), lambda x: F.trim(x))
    title = text(r"<xmp>([^<]+)</xmp>\s*</h3>")
    authors = every(r'<a href="/author/view/\d+"><xmp>([^<]+)</xmp>')
    others = every(r'<xmp>([A-Z][^<]{2,40})</xmp>\s*</a>\s*<span class="author-article-afil"')
    return F.struct(
        F.when(title != "", title).otherwise(first(r"<h3[^>]*>\s*<xmp>([^<]+)</xmp>")).alias("title"),
        F.when(F.size(authors) > 0, authors).otherwise(others).alias("authors"),
        text(r'<xmp class="abstract-article">([^<]+)</xmp>').alias("abstract"),
        text(r'<a href="/journal/view/\d+"\s*><xmp>([^<]+)</xmp>').alias("journal"),
        first(r"<xmp>(Vol[^<]*)</xmp>").alias("volume_issue"),
        first(r"Publish Date\s*</h4>\s*<p>([^<]+)</p>").alias("publish_date"),
        first(r'<a class="ui tag label[^"]*" href="/area/index/\d+">([^<]+)</a>').alias("subject"),
    )


def linked_ids(html: Column, path: str) -> Column:
    """Sorted distinct ids in links such as /journal/view/12."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(f'href="{path}/(\\d+)"'), 1), lambda x: x.cast("long"))))


def issue_links(html: Column) -> Column:
    """Issues named in links, decoded, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(r'href="[^"]*issue=([^"&]+)'), 1), lambda x: F.url_decode(x)))
