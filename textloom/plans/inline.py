"""Small tables for cases that the generated tables do not hold; both engines read the same rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

INDONESIAN = "Penelitian ini dilakukan untuk mengetahui pengaruh metode belajar yang baru terhadap hasil belajar siswa di sekolah dasar."

TABLES: dict[str, tuple[str, list[tuple]]] = {
    "texts": ("id long, text string", [
        (1, ""), (2, "   "), (3, "…!"), (4, "a"), (5, "a b"), (6, "😀a Ünïcode_9 x"), (7, "one two three one two three"),
        (8, "Page\n 12 \n\n\n\nnext  line\twith\t\ttabs\r\n7\r\nend "), (9, INDONESIAN), (10, "yang satu dua tiga empat"), (11, "yang satu dua tiga empat lima"),
        (12, "yang a b c d e f g h i j k l"), (13, "A short one. Then a Second sentence follows here! And 3 more words? yes lower case goes on."),
    ]),
    "cited": ("id long, text string", [
        (1, "As shown (Smith, 2020) and (Smith & Jones, 2019) or (Smith et al., 2018)."), (2, "See (Smith, 2020, p. 42) and (Smith, 2020; Jones, 2021)."),
        (3, "Smith (2020) says (Undang-Undang No. 20, 2003) and (Kementerian Pendidikan, 2022)."), (4, "> quoted line\nown line\n > more\nREFERENCES\n[1] Smith, A."),
        (5, "Text here.\n\nDaftar Pustaka:\nSmith 2020"), (6, "He said \"this is it\" and “that\nis that” and ‘so’ on."), (7, "See [12] and [ 3 ] and [Name] but not [two words]."),
        (8, "Read https://example.com/a?b=1 or doi:10.1/x or HTTP://X.ORG now."), (9, "A\n 1. Smith, A. x\n 2. Jones, B. y\nEnd  of\n\n\n\nit"),
        (10, "A\n 1. Smith, A. x\n 2. Jones, B. y\n 3. Young, C. z\nEnd"), (11, ""), (12, "According to him (Smith, 2020)."),
    ]),
    "files": ("name string", [("news_detik_ab12",), ("news_x",), ("arxiv__A",), ("openalex_en__B",), ("openalex__C",), ("crossref__D",), ("local__E",), ("cc_id__F",), ("my commoncrawl dump",), ("garuda__G",)]),
    "names": ("id long, name string", [
        (1, "1781338150646_hotUU3aC_My Report - 3.docx"), (2, "1781338150646_report.PDF"), (3, "plain.txt"), (4, "12_x.md"), (5, "a_b_c"), (6, ".txt"), (7, "Ünï/co\"de\\ name.rtf"),
    ]),
    "pairs": ("id long, a string, b string", [(1, "The quick <brown> fox, jumps", "A QUICK brown fox; (jumps)"), (2, "it is so", "it is so"), (3, "", "x"), (4, "Tom & \"Jerry's\" show", "show jerry's")]),
    "probabilities": ("id long, p double, perplexity double, n_words long, style double", [
        (1, 0.9, 20.0, 150, 0.7), (2, 0.9, 300.0, 100, 0.1), (3, 0.5, 60.0, 51, 0.5), (4, 0.5, 60.0, 50, 0.5), (5, 0.1, 150.0, 500, 0.2), (6, 0.97, 10.0, 101, 1.0), (7, 0.02, 1000.0, 10, 0.9), (8, 0.75, 30.0, 101, 0.0),
    ]),
    "logits": ("para long, kind string, score double, logit double", [(1, "exact", 0.95, -3.0), (2, "near", 0.5, 1.5), (3, "semantic", 0.8, -0.25), (4, "ensemble", 0.8, 0.0), (5, "near", 0.4, None)]),
    "sessions": ("sid string", [("abcdefgh12345678",), ("short",), ("with space 1234567890",), ("dash-under_score-1234",), ("",), ("x" * 129,)]),
    "listing": ("query_no long, source_no long, place long, doc_id string, title string", [(1, 1, 0, "a", "A1"), (1, 1, 1, "b", "B1"), (1, 2, 0, "a", "A2"), (2, 1, 0, "b", "B2"), (2, 1, 1, "c", "C1"), (2, 2, 0, "d", "D1"), (2, 2, 1, "c", "C2")]),
    "journals": ("subject long, place long, journal long", [(1, 0, 11), (1, 1, 12), (1, 2, 13), (2, 0, 21), (3, 0, 31), (3, 1, 32)]),
    "links": ("place long, link string", [
        (0, "https://x.com/a/1"), (1, "https://x.com/video/2"), (2, "https://x.com/a/1"), (3, "https://x.com/read/2020/01/02"), (4, "https://x.com/read/2020/01/02/slug"), (5, "https://x.com/foto/x"), (6, "https://x.com/b"),
    ]),
    "sitemaps": ("id long, xml string", [(1, "<urlset><url><loc>https://x.com/a/1</loc></url><url><loc> <![CDATA[https://x.com/b]]> </loc></url></urlset>"), (2, "<sitemapindex><sitemap><loc>https://x.com/s1.xml</loc></sitemap></sitemapindex>")]),
    "scholar": ("payload string", [(json.dumps({"data": [{"paperId": "p1", "title": "T1", "abstract": "An abstract.", "url": "u1", "year": 2020}, {"paperId": "p2", "title": "T2", "abstract": "", "url": "u2"}, {"paperId": "p3", "title": None, "abstract": "Third.", "year": 2019}]}),)]),
    "alex": ("payload string", [(json.dumps({"results": [{"id": "https://openalex.org/W1", "title": "T", "publication_year": 2021, "doi": "d1", "authorships": [{"author": {"display_name": f"A{i}"}} for i in range(7)], "abstract_inverted_index": {"we": [0, 3], "study": [1], "texts": [2, 4]}}, {"id": "https://openalex.org/W2", "title": "None"}]}),)]),
    "cross": ("payload string", [(json.dumps({"message": {"items": [{"DOI": "10.1/a", "title": ["First", "Other"], "abstract": "<jats:p>" + "word " * 30 + "</jats:p>", "URL": "u", "issued": {"date-parts": [[2018, 5]]}}, {"DOI": "10.1/b", "title": [], "abstract": "<p>" + "text " * 25 + "</p>"}, {"DOI": "10.1/c", "title": ["Short"], "abstract": "<p>short</p>"}]}}),)]),
    "abstracts": ("payload string", [(json.dumps({"docs": [{"id": "1", "title": "T", "abstract": "", "abstrak": "kata " * 12, "url": "u"}, {"id": "2", "title": "S", "description": "short"}]}),), (json.dumps({"results": [{"id": "3", "title": "R", "description": "word " * 11}]}),)]),
    "uploads": ("name string, length long, head string", [("a.pdf", 10, "%PDF-1.7"), ("a.PDF", 10, "PK"), ("b.docx", 10, "PK\x03\x04"), ("c.txt", 10, "x"), ("d.exe", 10, "MZ"), ("e.txt", 10485761, "x"), ("f.docx", 10, "x")]),
    "journal_pages": ("id long, html string", [
        (1, '<h3 class="t"><xmp>A Title</xmp> </h3><a href="/author/view/1"><xmp> Ann </xmp></a><a href="/author/view/2"><xmp>Bob</xmp></a><xmp class="abstract-article">The  abstract\ntext</xmp><a href="/journal/view/12" ><xmp>Journal X</xmp></a><xmp>Vol 1 No 2</xmp><h4>Publish Date </h4> <p> 01 Jan 2020 </p><a class="ui tag label" href="/area/index/3">Law</a>'),
        (2, '<h3><xmp>Other</xmp><xmp>Dora Lee</xmp> </a> <span class="author-article-afil">x</span><a href="/journal/view/9"></a><a href="/journal/view/12"></a><a href="/journal/view/9"></a>'),
    ]),
}


def table(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def _literal(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def values(name: str) -> str:
    """The same table as a DuckDB subquery."""
    schema, rows = TABLES[name]
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"string": "VARCHAR", "long": "BIGINT", "double": "DOUBLE"}
    columns = ", ".join(f"CAST({n} AS {kinds[k]}) AS {n}" for n, k in fields)
    listed = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"(SELECT {columns} FROM (VALUES {listed}) AS v({', '.join(n for n, _ in fields)}))"
