import gc
import os
import subprocess
import sys

import pandas as pd
from pyspark import cloudpickle

from wageband.schemas import RAW_COLUMNS
from wageband.sources import html_tree, pages
from wageband.sources.html_tree import parse

LONG = "Lowongan kerja penuh waktu untuk lulusan baru dengan jenjang karir yang jelas dan " \
       "lingkungan kerja yang baik serta tunjangan kesehatan dan bonus tahunan bagi semua karyawan tetap " \
       "di kota besar"
LISTING = f"""<!DOCTYPE html><html><head><title>Judul</title><style>p{{}}</style>
<script>var t="</p><a href='/job/9'>skrip panjang</a>";</script></head><body>
<article><h3><a href="/job/1?x=1">Data  Analyst</a></h3>
<span data-automation="jobCompany"> </span><span data-testid="company-name">PT&nbsp;Satu &amp; Dua</span>
<span data-automation="jobLocation">Bandung</span><p>{LONG}<p>Gaji <b>Rp 5.000.000</b> per bulan
<a href="/job/1?x=1">Data Analyst lagi</a> <a href="/job/2">ab</a></article>
<div id="outer"><span data-automation="job-salary-x">Rp 7 juta</span><p>{LONG}</p>
<div><div><a href="https://other.example/job/3">Tax Staff</a><!-- x --></div></div></div>
<a href="/about">Tentang kami</a><section><a href="/job/4">Tanpa kartu</a></section>
</body></html>"""


def _frame(spark, *htmls):
    return spark.createDataFrame(
        [(i, f"https://jobs.example.org/list/{i}", h) for i, h in enumerate(htmls)],
        "page_id BIGINT, url STRING, html STRING").repartition(2)


def test_links(spark):
    rows = pages.extract_links(_frame(spark, LISTING, "", None)).orderBy("link_no").collect()
    assert [(r.job_url, r.job_title) for r in rows] == [
        ("https://jobs.example.org/job/1?x=1", "Data Analyst"),
        ("https://other.example/job/3", "Tax Staff"),
        ("https://jobs.example.org/job/4", "Tanpa kartu")]
    other = pages.extract_links(_frame(spark, LISTING), base_url="https://h/x").first()
    assert other.job_url == "https://h/job/1?x=1"


def test_cards(spark):
    rows = {r.job_title: r for r in pages.extract_cards(_frame(spark, LISTING)).collect()}
    article = rows["Data Analyst"]
    assert (article.company, article.location) == ("PT Satu & Dua", "Bandung")
    assert article.card_text.startswith("Data Analyst PT Satu & Dua Bandung Lowongan")
    # No pay element: the words around the pay marker are used.
    assert "Rp 5.000.000 per bulan" in article.salary_text
    climbed = rows["Tax Staff"]
    assert climbed.salary_text == "Rp 7 juta" and climbed.card_text.endswith("Tax Staff")
    # The climb runs out of enclosing elements: nothing is left of the card.
    lost = rows["Tanpa kartu"]
    assert (lost.card_text, lost.company, lost.salary_text) == ("", "", "")


def test_details(spark):
    exact = f'<main>utama</main><div data-automation="jobAdDetails">{"x" * 100}</div>'
    longer = f'<div data-automation="jobDescription">{"y" * 101}</div><main>{"z" * 200}</main>'
    huge = f"<title>T</title><body>{'w ' * 6600}<script>hidden</script></body>"
    texts = {r.page_id: r.detail_text
             for r in pages.extract_details(_frame(spark, exact, longer, huge)).collect()}
    assert texts[0] == "utama " + "x" * 100
    assert texts[1] == "y" * 101
    assert len(texts[2]) == 12_000 and texts[2].startswith("T w w") and "hidden" not in texts[2]


def test_postings_from_pages(spark):
    listing = pages.extract_cards(_frame(spark, LISTING, LISTING), base_url="https://h")
    detail = spark.createDataFrame(
        [(1, "https://h/job/1?x=1", "rinci"), (2, "https://h/job/1?x=1", "kedua")],
        "page_id BIGINT, url STRING, detail_text STRING")
    rows = pages.page_postings(listing, detail, ["page_id", "link_no"]).collect()
    assert len(rows) == 3 and {r.page_id for r in rows} == {0}
    assert pages.to_raw(spark.createDataFrame(rows)).columns == RAW_COLUMNS
    described = {r.job_url: r.job_description for r in rows}
    assert described["https://h/job/1?x=1"].endswith(" rinci")
    assert described["https://other.example/job/3"].endswith("Tax Staff")


def test_unclosed_and_deep_markup():
    assert parse("<ul><li>a<li>b</ul><p>c<p>d").text() == "a b c d"
    assert parse("x &lt; y<br>z < 3").text() == "x < y z < 3"
    assert parse("<b>" * 20_000 + "deep").text() == "deep"
    tree = parse('<div id="1"><p>a</div><i>b</i>')
    assert [n.tag for n in tree.descendants()] == ["div", "p", "i"]


def test_pay_fallback_only_without_pay(spark):
    cards = spark.createDataFrame([("Rp 1", "gaji Rp 2"), ("", "gaji Rp 2"), (None, "kosong")],
                                  "salary_text STRING, card_text STRING")
    assert [r[0] for r in pages.with_pay_fallback(cards).select("salary_text").collect()] == [
        "Rp 1", "gaji Rp 2", ""]


def test_task_functions_need_no_installed_package(tmp_path):
    job = tmp_path / "job.pickle"
    job.write_bytes(cloudpickle.dumps(lambda: [
        r[1] for r in pages._card_rows(pages.parse(LISTING), "https://h", pages.LINK_MARK)]))
    run = subprocess.run(
        [sys.executable, "-c", "import pickle, sys; print(len(pickle.load(open(sys.argv[1], 'rb'))()))",
         str(job)], cwd=tmp_path, capture_output=True, text=True, env={"PATH": os.environ["PATH"]})
    assert run.stdout.strip() == "3", run.stderr


def _by_library(html):
    tree = html_tree.Tree()
    builder = html_tree._Builder(tree)
    builder.feed(html)
    builder.close()
    tree.done()
    return tree


def _shown(tree):
    return [(n.tag, n.attrs, n.parent and n.parent.number, tree.text(n), len(tree.descendants(n)))
            for n in tree.descendants()] + [tree.text()]


def test_well_formed_pages_take_the_short_way(monkeypatch):
    well_formed = [
        LISTING, "", "nur Text &amp; mehr", "<p>a<p>b<br/>c<hr>", "<A HREF='/job/1?a=1&amp;b' id=x/y disabled>T</a >",
        "<template><div>in <a href=x>link</a></div></template>after<script>a</p></script >z",
        "a<!-- x -->b<!doctype html>c</q>d", "<ul><li>1<li>2<ul><li>3</ul></ul><table><tr><td>4<td>5</table>"]
    expected = [_shown(_by_library(html)) for html in well_formed]
    monkeypatch.setattr(html_tree, "_Builder", None)
    assert [_shown(parse(html)) for html in well_formed] == expected


def test_other_markup_is_left_to_the_library():
    for html in ("z < 3", "<a href='x'y>t</a>", "<script>var a = 1", "<!-- a -- b -->c", "<?php x ?>d", "<b", "</>e",
                 "<script><!-- </script>f", "<i a==b>g", "</ b>h", "<a\x0bhref=x>i</a>"):
        assert not html_tree._read(html_tree.Tree(), html)
        assert _shown(parse(html)) == _shown(_by_library(html))


def test_pages_are_freed_without_a_collector():
    gc.disable()
    try:
        tree = parse(LISTING)
        before = len(gc.get_objects())
        for _ in range(50):
            tree = parse(LISTING)
        assert len(gc.get_objects()) < before + 50 and tree.text()
    finally:
        gc.enable()


def test_rows_are_handed_over_in_slices(spark, monkeypatch):
    monkeypatch.setattr(pages, "SLICE_CHARS", 3 * len(LISTING))

    class Rows:
        def select(self, *names):
            return self

        schema = _frame(spark, "").select("page_id").schema

        def mapInPandas(self, extract, schema):
            batch = pd.DataFrame({"page_id": range(60), "url": [""] * 60, "html": [LISTING] * 60})
            return list(extract(iter([batch])))

    made = pages._per_page(Rows(), lambda html, base: pages._page_rows(html, base, "/job/"),
                           pages.CARD_PARTS | pages.DETAIL_PARTS, None, ("page_id",))
    assert max(len(part) for part in made) < 30
    assert [i for part in made for i in part["page_id"]] == [i for i in range(60) for _ in range(4)]
