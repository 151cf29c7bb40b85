"""The training-text queries p4, p6, p8, p9 and p10 over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import canonical, linkage, mixing, spam, tokens
from touchline.operators.timestamps import UNRESOLVED, normalise_days
from touchline.session import cut, table

#: Fixed value: the country whose slashed dates are month first, and the prefix of its divisions.
MONTH_FIRST_COUNTRY, MONTH_FIRST_DIVISION = "Columbra", "US"


def _day(text: str):
    return F.unix_date(F.when(F.col(text) != UNRESOLVED, F.col(text)).cast("date"))


def _season(day):
    """The season a day (days since 1970) lies in, from July to June, as yyyy/yyyy."""
    date = F.date_from_unix_date(day)
    first = F.year(date) - F.when(F.month(date) < 7, 1).otherwise(0)
    return F.concat_ws("/", first, first + 1)


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "f3_ambiguous_identity_v1").select("row_no", "div_code", "date_text", "hometeam", "awayteam", "fthg", "ftag")
    results = normalise_days(results, "date_text", "d", F.upper(F.trim("div_code")).startswith(MONTH_FIRST_DIVISION)).withColumn("day", _day("d"))
    left = results.select(F.col("row_no").alias("i"), F.col("hometeam").alias("home_text"), F.col("awayteam").alias("away_text"), "day", _season(F.col("day")).alias("season"), F.col("fthg").alias("home_goals"), F.col("ftag").alias("away_goals"))
    countries = table(spark, sf_dir, "competitions").select("competition_id", "country_name").dropDuplicates(["competition_id"])
    matches = table(spark, sf_dir, "open_matches").select("match_id", "match_date", "kick_off", "competition_id", "season_name", "home_team_name", "away_team_name", "home_score", "away_score").join(countries, "competition_id", "left")
    month_first = F.col("country_name") == MONTH_FIRST_COUNTRY
    matches = normalise_days(normalise_days(matches, "match_date", "d", month_first), "kick_off", "k", month_first)
    right = matches.select(F.col("match_id").alias("j"), F.col("home_team_name").alias("home_text"), F.col("away_team_name").alias("away_text"), F.coalesce(_day("d"), _day("k")).alias("day"), F.col("season_name").alias("season"), F.col("home_score").alias("home_goals"), F.col("away_score").alias("away_goals"))
    # the words that many clubs of the club list share
    clubs = canonical.reference_parts(canonical.club_entries(table(spark, sf_dir, "product_teams")))
    return linkage.link(left, right, clubs.where("affix <> ''").select(F.explode(F.split("affix", " ")).alias("word")).distinct())


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_no, match_id: each row of the results CSV and the open match that is the same real match."""
    return _links(spark, sf_dir).select(F.col("i").alias("row_no"), F.col("j").alias("match_id")).distinct()


def p4_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_no, match_id, confidence: the same pairs, each with its confidence."""
    return _links(spark, sf_dir).select(F.col("i").alias("row_no"), F.col("j").alias("match_id"), "confidence")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mapping_id, team_id: the club that each mapping without a canonical id stands for, or UNMATCHED."""
    mappings = table(spark, sf_dir, "provider_mapping").where("canonical_team_id is null").select("mapping_id", "provider_team_name", "canonical_team_name", "country_code")
    clubs = canonical.club_entries(table(spark, sf_dir, "product_teams"))
    return canonical.map_names(mappings, "mapping_id", ["provider_team_name", "canonical_team_name"], F.col("country_code"), clubs).withColumnRenamed("entry", "team_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids: the byte_bpe_50k token ids of every text."""
    return tokens.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: every text again from its ids; empty for null."""
    return tokens.decode(p8_ids(spark, sf_dir), "doc_id", "ids")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", *mixing.TREE)
    # read several times below, and small: the sizes are written once
    return cut(tokens.token_counts(docs, "doc_id", "text", list(mixing.TREE)))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, site, lang, tokens, copies: the documents of the mix and how often each occurs in it."""
    return mixing.mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens planned and the shares that the mix of p9_mix reaches, a row per target."""
    sized, targets = _sized(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    planned = mixing.plan(sized, targets)
    return mixing.report(mixing.mix(sized, targets, planned=planned), sized, targets, planned)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of the keyword-stuffed and link-list pages."""
    return spam.spam_pages(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


def p10_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the characters of each page by kind of shape."""
    return spam.page_shapes(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


def queries():
    return {f.__name__: f for f in (p4_found, p4_confidence, p6_found, p8_ids, p8_decoded, p9_mix, p9_report, p10_found, p10_shapes)}


def oracle_sql() -> dict[str, str]:
    return {
        "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
