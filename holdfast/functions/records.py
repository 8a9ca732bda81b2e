"""Records of XML documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The elements of an article set that are read, with _VALUE for the text of an element that has attributes.
ARTICLES = (
    "PubmedArticle array<struct<MedlineCitation: struct<Article: struct<ArticleTitle: string, Abstract: struct<AbstractText: array<string>>>>, "
    "PubmedData: struct<ArticleIdList: struct<ArticleId: array<struct<_VALUE: string, _IdType: string>>>>>>"
)


def article_records(xml: Column) -> Column:
    """The articles of a set, as an array of (pmid, title, abstract, doi): each field null where its element is missing, the first where there are several. No records where the text is null or does not parse."""
    found = F.from_xml(xml, ARTICLES, {"mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false"})["PubmedArticle"]

    def record(r: Column) -> Column:
        ids = r["PubmedData"]["ArticleIdList"]["ArticleId"]
        of = lambda kind: F.get(F.filter(ids, lambda i: i["_IdType"] == kind), F.lit(0))["_VALUE"]
        article = r["MedlineCitation"]["Article"]
        return F.struct(of("pubmed").alias("pmid"), article["ArticleTitle"].alias("title"), F.get(article["Abstract"]["AbstractText"], F.lit(0)).alias("abstract"), of("doi").alias("doi"))

    return F.coalesce(F.transform(found, record), F.array().cast("array<struct<pmid:string,title:string,abstract:string,doi:string>>"))
