import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tidewire.functions import markup, text


class Reader(HTMLParser):
    """The same rules over the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden, self.seen = [], [], []

    def handle_starttag(self, tag, attrs):
        own = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        self.seen.append(("start", tag, own))
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.append(tag)
        elif tag in markup.HIDDEN:
            self.hidden.append(tag)
        elif tag in markup.BREAKS:
            self.out.append(" ")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.seen.append(("end", tag, {}))
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
        elif tag in markup.BREAKS | markup.BREAKS_AT_END:
            self.out.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def library(html):
    r = Reader()
    r.feed(html)
    r.close()
    return " ".join("".join(r.out).split()), r.seen


CASES = [
    "", "plain", "a < b > c & d", "x<br>y<BR/>z", '<a title="a > b" href=x>t</a>', "<p>one</p><p>two</p>", "&eacute;&#8217;&#x2014;&amp;lt;&notit;&unknown; &copy", "<script>if (a<b) '</p>'</script>after",
    "<style>p > a {}</style >x", "<!DOCTYPE html><?php x ?>t", "<noscript>a<p>b</p></noscript>c", "<template><template>a</template>b</template>c",
    "<div a='1' b=\"2\" c=3 d e = 5 a=9>x</div>", "<3 hearts", "a<", "<SCRIPT>a</Script>b", "<p/>x</p/>y", "<a\nhref\n=\n'x'>t</a>",
]


@pytest.mark.parametrize("html", CASES)
def test_scanner_equals_the_standard_librarys(html):
    assert markup.visible(html) == library(html)[0]
    assert [x for x in markup.scan(html) if x[0] in ("start", "end")] == library(html)[1]


@pytest.mark.parametrize(
    ("html", "wanted"),
    [
        # where older versions of the standard library's parser differ from the HTML standard
        ("<!-- a -- > b -->x<!---->y<!-->z", "xyz"),
        ("<title>a <b> &amp; c</title>d", "a <b> & c d"),
        ("<textarea><p>x &lt;</textarea>y", "<p>x <y"),
        ("</p x='>'>y", "y"),
        ("<!-- never closed", ""),
        ("x<p", "x"),
    ],
)
def test_scanner_follows_the_standard(html, wanted):
    assert markup.visible(html) == wanted


def test_scanner_equals_the_standard_librarys_on_pages_and_made_up_ones(spark, sf_small):
    pages = [r["html"] for r in spark.read.parquet(f"{sf_small}/pages.parquet").collect()]
    rng = random.Random(0)
    parts = ["<p>", "</p>", "text ", "&amp;", "&lt;", "<b class='x>y'>", "</b>", "<script>1 < 2</script>", "<!-- c > -->", "<br/>", "\n", "é", "<title>t</title>", "<style>a{}</style>", "<noscript>n</noscript>", '<a href="?a=1&amp;b=2">']
    pages += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(500)]
    assert all(markup.visible(p or "") == library(p or "")[0] for p in pages)


def test_text_of_columns(spark):
    rows = spark.createDataFrame([(1, "<p>a&nbsp;b</p>c"), (2, None), (3, "  x  y "), (4, "x" * 70_000 + "<" * 5000), (5, '<a "' * 3000)], "id int, h string").select("id", text.html_text(F.col("h")).alias("t"), text.page_image(F.col("h")).alias("i")).collect()
    got = {r["id"]: r["t"] for r in rows}
    assert got[1] == "a b c" and got[2] == "" and got[3] == "x y" and got[4] == "x" * 70_000 + "<" * 5000 and got[5] == "" and all(r["i"] is None for r in rows)
    assert markup.meta("<meta name=A content=1><meta name=a content=2><link rel='x image_src' href=h><meta content=3>") == {"a": "1", "link:x": "h", "link:image_src": "h"}


def test_pages_cut_inside_a_reference_equal_their_sql(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq
    from oracle import connect, difference

    import __spark_entry__ as entry

    titles = ["one &amp", "two &lt three &gt", "four &ampx &amp;lt; &#39", "five &amp;amp &quot;", "A &nbsp b&nbsp;c"]
    rows = [(i, f"<html><title>{t}</title><p>{t}</p>") for i, t in enumerate(titles)] + [(90, None), (91, "<TITLE>x</TITLE>y"), (92, "")]
    pq.write_table(pa.table({"page_id": [r[0] for r in rows], "html": [r[1] for r in rows]}), tmp_path / "pages.parquet")
    for name in ("page_titles", "page_texts"):
        with connect(tmp_path) as con:
            assert difference(spark, con, entry.queries()[name], entry.oracle_sql()[name], tmp_path) == ""


def test_closed_references():
    assert markup.closed_references("&amp &amp; &eacute;&eacute &#39;&#39 &#x2014; &nothing; &notit;") == "&amp & é&eacute '&#39 — &nothing; &notit;"
