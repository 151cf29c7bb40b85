import pytest

pytest.importorskip("touchline.llm.spam")
from touchline.llm import spam  # noqa: E402

SENTENCES = "The keeper held the ball with ten men behind the line. A patient crowd sang through the rain until the end. The referee added six minutes, enough for one more chance. "
SPAM = {
    "tags": "Tags: cheap tickets | kids | sale | home shirt XL | scarf red | away jersey | sale | kids | boots | cheap tickets red",
    "commas": ", ".join(f"goalkeeper gloves {p}" for p in ("Abbey", "Birk", "Corby", "Dale", "Elm", "Frome", "Gale", "Hythe", "Ives")),
    "no separators": " ".join(f"cheap tickets {p}" for p in ("Abbey", "Birk", "Corby", "Dale", "Elm", "Frome", "Gale", "Hythe", "Ives", "Jarrow", "Kent")),
    "lines": "\n".join(["home shirt sale", "boots size guide", "home shirt sale", "best odds today", "boots size guide"] * 3),
    "links": "\n".join(f"https://site{i}.example/p/{i}" for i in range(12)),
    "anchors": "\n".join(f'<li><a href="https://site{i}.example/p">Rovers cheap tickets</a></li>' for i in range(6)),
    "trails": "\n".join(f"Home > Shop > {p} > best odds" for p in ("Abbey", "Birk", "Corby", "Dale")),
    "hashtags": "#HomeShirt #CheapTickets #HomeShirt #BestOdds #Abbey #CheapTickets",
    "stock": "Best home shirt for you! Buy home shirt here. Looking for best odds? home shirt now. Top best odds. Top home shirt. best odds, home shirt and best odds. Buy best odds here. Top home shirt.",
}
CONTENT = {
    "report": SENTENCES * 3,
    "report with a foot": SENTENCES * 3 + "\nTags: Abbey, Birk, report, league",
    "accounts": "\n".join(SENTENCES + f"(https://site{i}.example/p/{i})" for i in range(4)),
    "squad": "\n".join(f"{i}. Arlo Venino (GK), {20 + i}" for i in range(1, 12)),
    "results": "\n".join(f"{p} Rovers {i}-1 {p} United" for i, p in enumerate(("Abbey", "Birk", "Corby", "Dale", "Elm"))),
    "table": "| Pos | Team | P | Pts |\n|---|---|---|---|\n" + "\n".join(f"| {i} | {p} Rovers | 36 | {90 - i} |" for i, p in enumerate(("Abbey", "Birk", "Corby", "Dale"))),
    "ticker": "\n".join(f"{i}' Goal - Arlo Venino (Abbey Rovers)" for i in range(5, 60, 9)),
    "chant": "\n".join(["la la la la, la la la la", "Oh Abbey, oh Abbey, we follow you down", "and the rain can fall and the wind can blow"] * 3),
    "json": '[{"rule": "duplicate_event", "row": 3, "team": "Abbey"}, {"rule": "duplicate_event", "row": 4, "team": "Abbey"}]',
    "quotes": "\n".join("> The keeper held the ball with ten men" for _ in range(5)),
    "short": "ok", "dot": ".", "empty": "", "blank": " \n\t ", "null": None, "odd": " \x00⚽�",
}


def test_pages(spark):
    pages = SPAM | CONTENT
    df = spark.createDataFrame([(k, t, 1) for k, t in pages.items()], "doc_id string, text string, chars int")
    assert {r.doc_id for r in spam.spam_pages(df, "doc_id", "text").collect()} == set(SPAM)
    groups = {r.doc_id: r for r in spam.page_groups(df, "doc_id", "text").collect()}
    assert len(groups) == len(pages) and groups["null"].chars == 0 and all(sum(g.n for g in r.groups) == r.chars for r in groups.values())
    # equal shapes are one group: the links of a list, the rows of a table
    assert len(groups["links"].groups) == 1 and groups["links"].groups[0].lines == 12
    rows = spam.page_shapes(df, "doc_id", "text").where("doc_id = 'report'").collect()
    assert rows and not any(r.bad for r in rows)


def test_repetition_wherever_it_stands(spark):
    """Lists behind a quotation mark, lines of middling length that repeat each other, two stock sentences among keywords: by the share of repeated words, not by their place."""
    pages = {
        "quoted list": "\n".join("> cheap tickets | home shirt | best odds | away jersey | boots sale" for _ in range(4)),
        "middling": "\n".join(f"cheap match tickets {p} for cheap match tickets {p} today" for p in ("Abbey", "Birk", "Corby", "Dale", "Elm", "Frome")),
        "many different sentences": SENTENCES * 2 + "\n".join(f"The {a} of {b} found the {c} late." for a in ("pass", "run", "cross") for b in ("Abbey", "Birk") for c in ("post", "net")),
    }
    df = spark.createDataFrame(list(pages.items()), "doc_id string, text string")
    assert {r.doc_id for r in spam.spam_pages(df, "doc_id", "text").collect()} == {"quoted list", "middling"}


def test_long_repeated_and_empty(spark):
    df = spark.createDataFrame([(1, SENTENCES * 2000), (1, SPAM["links"] * 300), (1, SPAM["links"] * 300), (None, SPAM["tags"])], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in spam.spam_pages(df, "doc_id", "text").collect()) == ["1", "1", "None"]
    assert spam.spam_pages(df.limit(0), "doc_id", "text").collect() == []
