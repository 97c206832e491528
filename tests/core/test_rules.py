"""Rules without SQL, by example and by property."""

import io
import random
import re
import zipfile
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import period, rules
from tessella.functions import text as x
from tessella.operators import chunking, crawl, state
from tessella.sources import embedding, office, web


@pytest.mark.parametrize(
    ("text", "masked"),
    [
        ("карта 5058 1234 5678 9012", "карта [CARD]"), ("5058.1234.5678.9012", "[CARD]"), ("5058-1234-5678-9012 и 4058 1234 5678 9012", "[CARD] и [CARD]"),
        ("+992 93 123 45 67", "[PHONE]"), ("звоните 931234567", "звоните [PHONE]"), ("(93) 123-45-67", "([PHONE]"), ("паспорт A12345678", "паспорт [PASSPORT]"), ("А 12345678", "[PASSPORT]"),
        ("ИНН нашей компании 987654321", "ИНН нашей компании [INN]"), ("счёт 20202972000000000001", "счёт [ACCOUNT]"), ("TJ02 1234 5678 9012 3456 7890", "[IBAN]"),
        ("01.02.2024", "01.02.2024"), ("35 000 сомони", "35 000 сомони"), ("Рақами 12345678", "Рақами 12345678"), ("12345678901", "12345678901"), ("1" * 30, "1" * 30), ("+1 (555) 123-4567", "+1 (555) 123-4567"),
    ],
)
def test_mask(spark, text, masked):
    assert _masked(spark, [text]) == [masked]


def _masked(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", rules.mask(F.col("t")))
    return [r[1] for r in sorted(df.collect())]


def _spans(text, separators, labels):
    """By every pair of groups of digits: from each first group the longest span whose digits fit."""
    groups = [(m.start(), m.end()) for m in re.finditer(r"[0-9]+", text)]
    out, at, i = "", 0, 0
    while i < len(groups):
        ends = [j for j in range(i, len(groups)) if all(set(text[groups[k][1] : groups[k + 1][0]]) <= set(separators) for k in range(i, j))]
        fitting = [j for j in ends if labels("".join(text[a:b] for a, b in groups[i : j + 1]))]
        if fitting:
            out, at, i = out + text[at : groups[i][0]] + labels("".join(text[a:b] for a, b in groups[i : fitting[-1] + 1])), groups[fitting[-1]][1], fitting[-1] + 1
        else:
            i += 1
    return out + text[at:]


def test_mask_by_all_spans(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["1", "22", "992", "93 1", "4444", "55555", " ", "-", ".", "b", "(", ")", "1234567", " x "]) for _ in range(rng.randint(1, 14))) for _ in range(600)]
    want = []
    for text in texts:
        text = _spans(text, " \t.\u00a0-", lambda d: "[ACCOUNT]" if len(d) == 20 else "")
        text = _spans(text, " \t.\u00a0-", lambda d: "[CARD]" if 13 <= len(d) <= 19 else "")
        want.append(_spans(text, " \t\u00a0()-", lambda d: "[PHONE]" if len(d) == 9 or len(d) == 12 and d.startswith("992") else ""))
    got = _masked(spark, texts)
    assert got == want and _masked(spark, got) == got
    assert any("[CARD]" in t for t in got) and any("[PHONE]" in t for t in got) and any("[ACCOUNT]" in t for t in got)
    assert _masked(spark, [None, "", "no digits"]) == [None, "", "no digits"]


@pytest.mark.parametrize(
    ("text", "rest"),
    [("Салом! Чигуна корт гирам?", "Чигуна корт гирам?"), ("Здравствуйте, подскажите, пожалуйста, курс", "курс"), ("Привет", "Привет"), ("У меня вопрос: Где банк?", "Где банк?"), ("Добрый день! Спасибо", "Добрый день! Спасибо"), ("", ""), ("приветливый", "приветливый"), (None, None)],
)
def test_strip_greeting(spark, text, rest):
    assert spark.createDataFrame([(text,)], "t string").select(rules.strip_greeting(F.col("t"))).first()[0] == rest


def test_repeats_and_markers():
    answer = "Ставка по вкладу составляет пятнадцать процентов годовых при сроке от двенадцати месяцев и более."
    assert rules.is_repeat(answer, ["другое", answer + " Да."]) and not rules.is_repeat(answer, ["другое"])
    assert not rules.is_repeat(answer, [answer], same_question=True) and rules.is_repeat(answer, [answer], same_question=True, affirmed=True)
    assert rules.collapse_repeats("a\nb\nA\na\nc") == "a\nb\nA"
    assert rules.split_visible("ответ [ESC") == ("ответ ", "[ESC") and rules.split_visible("x [ESCALATE] y") == ("x ", "") and rules.split_visible("a[b") == ("a[b", "")


def test_repeats_and_markers_on_columns(spark):
    answer = "Ставка по вкладу составляет пятнадцать процентов годовых при сроке от двенадцати месяцев и более."
    df = spark.createDataFrame([(1, answer, ["другое", answer + " Да."]), (2, answer, []), (3, None, [None])], "i int, a string, e array<string>")
    assert {r[0]: r[1] for r in df.select("i", rules.is_repeat_column(F.col("a"), F.col("e"))).collect()} == {1: True, 2: False, 3: False}
    buffers = ["ответ [ESC", "x [ESCALATE] y", "a[b", "", "[", "[[", "[ESCALATE", None]
    shown, held = x.split_visible(F.col("b"))
    for r in spark.createDataFrame([(b,) for b in buffers], "b string").select("b", shown.alias("s"), held.alias("h")).collect():
        assert (r["s"], r["h"] if r["b"] is not None else None) == (rules.split_visible(r["b"]) if r["b"] is not None else (None, None)), r


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    row = lambda *c: "<w:tr>" + "".join(f"<w:tc>{p(v)}</w:tc>" for v in c) + "</w:tr>"
    return _zip({"word/document.xml": f"<w:document {w}><w:body>{p('Начало')}<w:tbl>{row('Вид', 'Ставка')}{row('Срочный', '15 %')}</w:tbl>{p('')}{p('Конец')}</w:body></w:document>"})


def xlsx():
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Сумма</t></is></c></row><row r="2"/><row r="3"><c r="A3" t="inlineStr"><is><t>Вклад</t></is></c><c r="B3"><v>500.0</v></c></row>'
    return _zip({
        "xl/workbook.xml": f'<workbook {s}><sheets><sheet name="a" sheetId="1" r:id="r1"/><sheet name="b" sheetId="2" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {s}><si><t>Имя</t></si></sst>", "xl/worksheets/s1.xml": f"<worksheet {s}><sheetData>{rows}</sheetData></worksheet>", "xl/worksheets/s2.xml": f"<worksheet {s}><sheetData/></worksheet>",
    })


def test_office_files(spark, tmp_path):
    assert office.parse_docx(docx()) == [(None, "Начало\nВид: Срочный | Ставка: 15 %\nКонец", False)]
    assert office.parse_xlsx(xlsx()) == [(1, "Имя: Вклад; Сумма: 500", False)]
    (tmp_path / "a.docx").write_bytes(docx())
    (tmp_path / "b.xlsx").write_bytes(xlsx())
    (tmp_path / "c.docx").write_bytes(b"not a zip")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    got = {r["path"][-6:]: (r["page"], r["error"]) for r in office.read_pages(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert got == {"a.docx": (None, None), "b.xlsx": (1, None), "c.docx": (None, "not a docx file"), "/d.pdf": (None, "PDF needs a backend")}


def test_pdf_pages_and_scans():
    text = "A page with a good deal of text, as pages of documents have."
    pdf, ocr = (lambda content: [text, " ", "3"]), lambda content, page: f"read from page {page}"
    assert office.parse_file("a.pdf", b"", pdf, ocr) == ([(1, text, False), (2, "read from page 2", True), (3, "read from page 3", True)], None)
    assert office.parse_file("a.pdf", b"", pdf)[0] == [(1, text, False), (3, "3", False)]
    assert office.parse_file("a.pdf", b"", lambda content: 1 / 0)[1].startswith("ZeroDivisionError")


def test_embedding(spark):
    def make():
        def encode(texts):
            assert 0 < len(texts) <= 32
            return [[len(t), 1.0] for t in texts]

        return encode

    df = spark.createDataFrame([(i, "x" * i) for i in range(1, 100)] + [(100, None), (101, " ")], "id long, text string").repartition(2)
    got = {r["id"]: r["embedding"] for r in embedding.embed(df, make, 2).collect()}
    assert len(got) == 101 and got[7] == [7.0, 1.0] and got[100] is got[101] is None
    with pytest.raises(Exception, match="dimensions"):
        embedding.embed(df, make, 3).collect()


def test_web_page_in_any_state():
    assert web.parse_html("<p>a</p><![foo bar]><p>b</p>")[1] == "a\nb" and web.parse_html("<b>" * 20_000 + "</i>" * 20_000 + "t")[1] == "t"


def test_web_pages():
    html = """<html><head><title> T  1 </title><base href="/b/"><link rel="canonical" href="c"><meta name="robots" content="noindex, nofollow"><link rel="alternate" hreflang="tg" href="https://tj.x.y/"></head>
    <body><nav>menu</nav><main><h1>H</h1><p>One <b>two</b></p><script>no()</script></main><a href="p?a=1">x</a><a rel="nofollow" href="q">y</a><a href="#z">z</a><select name="language"><option value="https://en.x.y/">E</option></select></body></html>"""
    assert web.parse_html(html) == ("T 1", "H\nOne two")
    page = web.read_page(html, "https://x.y/a/")
    assert (page.canonical, page.noindex, page.nofollow, page.links, page.variants) == ("https://x.y/b/c", True, True, ["https://x.y/b/p?a=1"], ["https://tj.x.y/", "https://en.x.y/"])
    assert web.decode("привет".encode("cp1251"), "text/html; charset=windows-1251") == "привет"
    assert web.decode(b'<meta charset="koi8-r">' + "да".encode("koi8-r")).endswith("да") and web.decode("да".encode(), "text/html; charset=nonsense") == "да"


@given(st.lists(st.text(alphabet="abc .!?", min_size=1, max_size=400), max_size=12))
@settings(max_examples=60, deadline=None)
def test_chunks_keep_order_and_limits(lines):
    pieces = [p for line in lines if line.strip() for p in chunking.split_paragraph(line.strip())]
    chunks = chunking.chunk_page("\n".join(lines), "H")
    assert all(c.startswith("H\n") for c in chunks) and bool(chunks) == bool(pieces)
    flat = [line for c in chunks for line in c.split("\n")[1:]]
    at = 0
    for line in flat:  # overlaps repeat pieces, but none is lost or moved ahead
        if at < len(pieces) and line == pieces[at]:
            at += 1
    assert at == len(pieces)


def test_long_paragraphs_are_split():
    words = " ".join(["word"] * 3000)
    assert all(len(p.split()) <= 400 for p in chunking.split_paragraph(words)) and " ".join(chunking.split_paragraph(words)) == words


def test_crawl(spark):
    site = crawl.synthetic_site(spark, 60)
    got = {r["key"]: (r["depth"], r["state"]) for r in crawl.crawl_snapshot(site, "https://site.example/", max_depth=2).collect()}
    assert len(got) == 43 and got["https://site.example/"] == (0, "indexed") and got["https://site.example/p/7"] == (2, "indexed") and got["https://site.example/p/10"] == (2, "copy")
    assert crawl.crawl_snapshot(site, "https://site.example/", max_pages=5).count() == 5
    starts = spark.createDataFrame([("a", "https://site.example/"), ("b", "https://site.example/p/1"), ("c", "https://nowhere.example/")], "site string, url string")
    both = crawl.crawl_sites(site, starts, max_depth=1).groupBy("site").count().collect()
    assert {r["site"]: r["count"] for r in both} == {"a": 7, "b": 7}
    assert crawl.crawl_snapshot(site, "https://site.example/", disallowed=("/p/1",)).where("key LIKE '%/p/1%'").count() == 0


def test_trim_history(spark):
    turns = [("user", "a" * 100), ("assistant", "b" * 1450), ("user", "c" * 40), ("assistant", "d" * 1490)]
    df = spark.createDataFrame([(turns,)], "turns array<struct<role: string, text: string>>")
    kept = df.select(state.trim_history(F.col("turns"), budget=1500).alias("k")).first()["k"]
    assert [t["text"][0] for t in kept] == ["d"]
    kept = df.select(state.trim_history(F.col("turns"), budget=1600).alias("k")).first()["k"]
    assert [t["text"][0] for t in kept] == ["c", "d"]  # 70 characters are left, too few for the first turn
    kept = df.select(state.trim_history(F.col("turns"), budget=1640).alias("k")).first()["k"]
    assert [t["text"][0] for t in kept] == ["a", "c", "d"]  # what doesn't fit costs nothing
    df = spark.createDataFrame([([("user", " \u00a0x "), ("user", " "), ("user", None), ("user", "y")],)], "turns array<struct<role: string, text: string>>")
    assert [t["text"] for t in df.select(state.trim_history(F.col("turns"), budget=2).alias("k")).first()["k"]] == ["x", "y"]


def test_smalltalk_is_whole_messages(spark):
    df = spark.createDataFrame([("Салом!!!",), ("салом, карта",), (None,)], "t string")
    assert [r[0] for r in df.select(x.smalltalk(F.col("t"))).collect()] == ["greeting", None, None]


@pytest.mark.parametrize(
    ("phrase", "since", "until"),
    [
        ("за сегодня", "2026-08-17 00:00", "2026-08-17 13:40"), ("вчера", "2026-08-16 00:00", "2026-08-17 00:00"), ("прошлая неделя", "2026-08-10 00:00", "2026-08-17 00:00"), ("эта неделя", "2026-08-17 00:00", "2026-08-17 13:40"),
        ("за прошлый месяц", "2026-07-01 00:00", "2026-08-01 00:00"), ("за июнь", "2026-06-01 00:00", "2026-07-01 00:00"), ("в декабре", "2025-12-01 00:00", "2026-01-01 00:00"), ("июнь 2025", "2025-06-01 00:00", "2025-07-01 00:00"),
        ("за 3 дня", "2026-08-14 13:40", "2026-08-17 13:40"), ("за две недели", "2026-08-03 13:40", "2026-08-17 13:40"), ("за все дни", "2026-08-14 13:40", "2026-08-17 13:40"), (None, "2026-08-10 13:40", "2026-08-17 13:40"), ("как дела", "2026-08-10 13:40", "2026-08-17 13:40"),
        ("за 5000 дней", "2025-08-16 13:40", "2026-08-17 13:40"),
    ],
)
def test_periods(spark, phrase, since, until):
    df = spark.createDataFrame([(phrase, datetime(2026, 8, 17, 13, 40))], "phrase string, now timestamp_ntz")
    got = period.parse_periods(df).first()
    assert (f"{got.since:%Y-%m-%d %H:%M}", f"{got.until:%Y-%m-%d %H:%M}") == (since, until)
    assert got.assumed == (phrase in ("как дела", None))


def test_period_titles(spark):
    rows = [("эта неделя", "эта неделя · 17 августа 2026", 1), ("за июнь", "июнь 2026 · 1–30 июня 2026", 30), ("за год", "последние 365 дней · 17 августа 2025 — 17 августа 2026", 365), ("за 3 месяца", "последние 90 дней · 19 мая — 17 августа 2026", 90)]
    df = spark.createDataFrame([(p, datetime(2026, 8, 17, 13, 40)) for p, _, _ in rows], "phrase string, now timestamp_ntz")
    assert {(r["phrase"], r["title"], r["days"]) for r in period.parse_periods(df).collect()} == set(rows)


def test_names_stay_out_of_patterns():
    assert not re.search(r"\\b", "".join((x.PII_PERSONAL, x.OPERATOR_WORDS)))


ROBOTS = """# for all
User-agent: *
Disallow: /private
Allow: /private/open$
Disallow: /*.pdf$
Disallow: /q?a=*b
Crawl-delay: 2.5

User-agent: other
User-agent: Own
Allow: /
Disallow: /own/*/deep
Disallow:
Sitemap: https://x/s
Crawl-delay: soon
"""


def test_robots(spark):
    """Groups shared by agents, the longest match, wildcards and ends, ties, no file, odd files."""
    from tessella.functions import robots

    files = [("a", ROBOTS), ("b", None), ("c", "Disallow: /x\nnonsense\n: \nUser-agent:\nDisallow: /"), ("d", "user-agent : *\r\nDISALLOW: /A # note\rAllow: /a\nDisallow: /a"), ("e", "﻿User-agent: *\nDisallow: /(\nCrawl-delay: 99999")]
    table = spark.createDataFrame(files, "site string, robots string")
    tried = [("a", p) for p in ("/", "/private", "/private/open", "/private/open/x", "/x.pdf", "/x.pdf?y", "/q?a=1b", "/q?a=1c", None)] + [("b", "/x"), ("c", "/x"), ("d", "/A"), ("d", "/ab"), ("e", "/("), ("e", "/x"), ("z", "/x"), ("a", "/")]
    urls = spark.createDataFrame([(i, *x) for i, x in enumerate(tried)], "i int, site string, path string")
    got = {r["i"]: r["allowed"] for r in robots.allowed(urls, robots.rules_for(table, "reader")).collect()}
    assert [got[i] for i in range(len(tried))] == [True, False, True, False, False, True, False, True, True, True, True, False, True, False, True, True, True]
    own = robots.rules_for(table, "OwnReader/2.0")
    deep = spark.createDataFrame([("a", p) for p in ("/private", "/own/x/deep/er", "/own/deep")], "site string, path string")
    assert {r["path"]: r["allowed"] for r in robots.allowed(deep, own).collect()} == {"/private": True, "/own/x/deep/er": False, "/own/deep": True}
    times = robots.fetch_times(urls, robots.rules_for(table, "reader"), "i", pause=0.5)
    at = {}
    for r in sorted(times.collect(), key=lambda r: r["i"]):
        at.setdefault(r["site"], []).append(r["starts_at"])
    assert at["a"] == [2.5 * k for k in range(10)] and at["b"] == [0.0] and at["d"] == [0.0, 0.5] and at["e"] == [0.0, 3600.0]
    assert robots.allowed(urls.limit(0), own).count() == 0 and robots.allowed(urls, own.limit(0)).where("NOT allowed").count() == 0


def test_crawl_keeps_to_robots_and_to_its_budget(spark):
    """Rules of the host; a budget that ends inside a level gives the first pages in breadth-first order of the crawl without one."""
    from tessella.functions import robots

    site, start = crawl.synthetic_site(spark, 200), "https://site.example/"
    rules = robots.rules_for(spark.createDataFrame([("site.example", "User-agent: *\nDisallow: /p/1\nAllow: /p/1$")], "site string, robots string"), "reader")
    got = {r["key"] for r in crawl.crawl_snapshot(site, start, robots=rules).collect()}
    assert any(k.endswith("/p/1") for k in got) and not any(re.search(r"/p/1\d", k) for k in got) and any(k.endswith("/p/2") for k in got)
    every = sorted(crawl.crawl_snapshot(site, start, max_pages=10_000).collect(), key=lambda r: (r["depth"], r["path"]))
    for budget in (4, 20):
        cut = sorted(crawl.crawl_snapshot(site, start, max_pages=budget).collect(), key=lambda r: (r["depth"], r["path"]))
        assert [r["key"] for r in cut] == [r["key"] for r in every[:budget]]
