import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import paths, text, urls
from quillmesh.functions.html import whole_text
from quillmesh.functions.markdown import markdown_html, plain_markdown
from quillmesh.functions.speech import speakable
from quillmesh.operators.web import main_content_of, visible_text_of
from quillmesh.streaming.thinking import ThinkingFilter, rebuffered

HARD = [None, "", "   ", "\u00a0\u2003", "ﬁn ａｂｃ", "a\u00adb\u200bc\ufeffd", "x🙂y", "\ue000z\ufffd", "a\r\nb\rc", "a\x07\x85b", "l1\n\n\n\n\nl2", "tab\tkept \t here", " a \n  b ", "e\u0301", "\x1cstrip\x1f", "a" * 5000]


def values(spark, column, rows=HARD):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string")
    return [r[0] for r in df.select(column(F.col("t")).alias("x"), "k").orderBy("k").collect()]


def normalized(t, keep=True):
    if t is None:
        return None
    invisible = {0xAD, 0xFEFF, *range(0x200B, 0x2010), *range(0x2060, 0x2065)}
    out = []
    for c in unicodedata.normalize("NFKC", t):
        n = ord(c)
        if c in "\n\t":
            out.append(c if keep else " ")
        elif c == "\r":
            out.append(" ")
        elif not (n < 32 or 127 <= n <= 159 or n > 0xFFFF or n == 0xFFFD or 0xE000 <= n <= 0xF8FF or n in invisible):
            out.append(c)
    t = "".join(out)
    if keep:
        t = re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", re.sub(r"[^\S\n\t]+", " ", t)))
    else:
        t = re.sub(r"\s+", " ", t)
    return t.strip() or None


@pytest.mark.parametrize("keep", [True, False])
def test_normalize(spark, keep):
    assert values(spark, lambda c: text.normalize(c, keep)) == [normalized(t, keep) for t in HARD]


def test_normalize_twice_is_once(spark):
    once = values(spark, text.normalize)
    assert values(spark, text.normalize, once) == once


def test_query_form(spark):
    assert values(spark, text.normalize_query, ["", None, " a\n b\t", "x\u0085y"]) == [" ", None, "a b", "x y"]


def test_strip_is_unicode(spark):
    assert values(spark, text.strip) == [None if t is None else t.strip() for t in HARD]


def test_clean_context(spark):
    rows = ["a\n \t\nb", "a\n\n\n\nb", "  x  ", "a\n \n \nb\n"]
    expected = [re.sub(r"\n\s*\n\s*\n*", "\n\n", re.sub(r"\n[ \t]+\n", "\n\n", t).strip()) for t in rows]
    assert values(spark, text.clean_context, rows) == expected


def test_corrupt_fraction(spark):
    rows = ["", " ", "abcd", "ab\ufffd\ue000", "(cid:12)", " x(cid:1) "]
    assert values(spark, text.corrupt_fraction, rows) == [0.0, 0.0, 0.0, 0.5, 1.0, 7 / 8]


THOUGHTS = ["plain", "<think>a</think>b", "x<thinking>y", "a</think> b", "<think>a<thinking>b</think>c", "<think>a</thinking>  c", "<thin", "", None]


def test_strip_thinking(spark):
    assert values(spark, text.strip_thinking, THOUGHTS) == ["plain", "b", "x", "a b", "c", "c", "<thin", "", None]


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_thinking_in_pieces(spark, size):
    whole = values(spark, text.strip_thinking, THOUGHTS)
    for t, expected in zip(THOUGHTS, whole):
        if t is not None:
            f = ThinkingFilter()
            assert "".join(f.feed(t[k : k + size]) for k in range(0, len(t), size)) + f.finish() == expected


def test_rebuffered():
    assert rebuffered(["a" * 30, "b" * 30, "c\n", "d"]) == ["a" * 30 + "b" * 30, "c\n", "d"]


def test_pack_sentences(spark):
    long = " ".join(["word"] * 60)
    packed = values(spark, text.pack_sentences, ["Short one. Two!", long, "x" * 150, None])
    assert packed[0] == ["Short one.", "Two!"] and packed[2] == ["x" * 150] and packed[3] is None
    assert all(len(p) <= 115 for p in packed[1]) and packed[1][1].startswith("<continue> ")
    assert " ".join(p.removeprefix("<continue> ") for p in packed[1]) == long


def test_speakable(spark):
    said = {
        "It is 3:05 and 12:00": "It is 3 oh 5 and 12 o'clock",
        "at 7:45, not 13:20 or 1:2:30": "at 7 45, not 13:20 or 1:2:30",
        "In 1984 and the 1900s": "In 19 84 and the 19 hundreds",
        "1066, 1206, 2000, 2007 and the 2010s": "1066, 12 oh 6, 2000, 2007 and the 20 10s",
        "costs $5.50 or £1": "costs 5 dollars and 50 cents or 1 pound",
        "$1.01, $3.5, £2.01, £4.00 and $20": "1 dollar and 1 cent, 3 dollars and 50 cents, 2 pounds and 1 penny, 4 pounds and 0 pence and 20 dollars",
        "$2 million": "2 million dollars",
        "$1.5 Billion": "1.5 Billion dollars".replace("1.5", "1 point 5"),
        "Dr. Smith § 5": "Doctor Smith section 5",
        "Mr. X, Mrs. Y and the dr. of it": "Mister X, Mrs Y and the dr. of it",
        "pi is 3.14": "pi is 3 point 1 4",
        "version .1984 and 1984.5": "version point 1 9 8 4 and 1984 point 5",
        "1,234 pages": "1234 pages",
        "1. first": "first",
        "“so” it\u2019s\t done": "so\" it's done",
        "": "",
        None: None,
    }
    assert dict(zip(said, values(spark, speakable, list(said)))) == said


def test_paths(spark):
    rows = ["C:\\a\\b.TXT", "/x/y.tar.gz", "noext", "/d/.hidden", "", None]
    assert values(spark, paths.base_name, rows) == ["b.TXT", "y.tar.gz", "noext", ".hidden", "", None]
    assert values(spark, paths.extension, rows) == [".txt", ".gz", "", "", "", None]
    assert values(spark, paths.stem, rows) == ["b", "y.tar", "noext", ".hidden", "", None]


def test_url_validity(spark):
    def valid(url, base="docs.example", path="/docs"):
        return spark.range(1).select(urls.is_valid(F.lit(url), F.lit(base), F.lit(path))).first()[0]

    assert valid("https://www.docs.example/docs/x") and valid("http://docs.example/docs")
    assert not valid("https://docs.example/docs-old/x") and not valid("https://other.example/docs") and not valid("nonsense")
    assert valid("https://docs.example/foo-v1.3", path="/foo-v1.2") and not valid("https://docs.example/foo-bar", path="/foo")
    assert valid("https://docs.example/anything", path="")


def test_hrefs(spark):
    rows = [("https://a.example/x/y", h) for h in ("/z", "z?q#f", "www.b.example/c", "https/b.example", "../up", "//c.example/d", "&amp;num;frag", "mailto:x@y")]
    df = spark.createDataFrame(rows, "u string, h string")
    assert [r[0] for r in df.select(urls.canonical(urls.absolute(F.col("u"), F.col("h")))).collect()] == [
        "https://a.example/z", "https://a.example/x/z", "https://www.b.example/c", "https://b.example", "https://a.example/up", "https://c.example/d", "https://a.example/x/y", "mailto:x@y",
    ]


def test_file_names(spark):
    name = lambda u: spark.range(1).select(urls.file_name(F.lit(u))).first()[0]
    assert name("https://a.example/b/c.html") == "a.example_b_c"
    assert name("https://con") == "file_con"
    assert name("https://a.example/f(x)[y]") == "a.example_f"
    assert re.fullmatch(r"a\.example_b_[0-9a-f]{8}", name("https://a.example/b?q=1"))
    assert len(name("https://a.example/" + "p" * 400)) <= 250
    assert name("https://a.example/b.. ") == "a.example_b"


PAGE = """<html><head><script>var a = "</p>";</script></head><body onload="x()"><nav>menu</nav><div class="a rst-content b"><h1>T &amp; t</h1><p onclick="y()">one<p>two
<!-- no --><section><h2>License</h2>mit</section><p><a>Prev</a> <a>Next</a></p><div class="sidemenu">side</div></div><footer>foot</footer></body></html>"""


def test_html():
    assert visible_text_of(PAGE) == "T & t one two"
    inner = main_content_of(PAGE, "readthedocs")
    assert "onclick" not in inner and "mit" not in inner and "Prev" not in inner and "side" not in inner and "one" in inner
    assert main_content_of(PAGE, "pytorch") == "<html><body></body></html>" and main_content_of(PAGE, None) == PAGE and main_content_of(None, "main") is None


def test_pages_of_any_depth():
    deep = "<div>" * 20_000 + "<p>end</p>"
    assert visible_text_of(deep) == "end" and whole_text(deep) == "end" and main_content_of(f"<body>{deep}", "body").count("</div>") == 20_000
    sections = "<section>" * 5_000 + "<h2>License</h2>mit"
    assert visible_text_of(sections) == "" and visible_text_of("<p><a>Next</a> more</p><p><a>previous</a></p>") == "Next more"
    assert visible_text_of("</b></p>x<br>y<p>z") == "x y z" and visible_text_of("") == ""


def test_whole_text_keeps_everything():
    assert whole_text("<nav>menu</nav><p>a  b</p><script>no</script><section><h2>License</h2>mit</section><footer>foot</footer>").split() == ["menu", "a", "b", "License", "mit", "foot"]


def test_markdown_components():
    source = 'a\n<Tabs>\n<Tab title="One #">\ninner\n</Tab>\n</Tabs>\n<Note>careful</Note>\n```python title="x" label\n<Tab>\n\n\n\n```\n`<Tab>` b'
    assert plain_markdown(source) == "a\n\n## One \\#\n\ninner\n\n> careful\n\n**label**\n\n```python\n<Tab>\n\n\n\n```\n`<Tab>` b"
    assert plain_markdown('<Steps>\n  <Step title="A">\n    one\n      two\n  </Step>\n</Steps>') == "## A\n\none\n  two"
    assert plain_markdown("see <Tooltip tip='x'> this </Tooltip> now") == "see this now" and plain_markdown("a <Unknown b={1}/>c</Card>") == "a c"
    assert plain_markdown("> ## Documentation Index\n> all pages\n> here\n\n# Title") == "# Title" and plain_markdown(None) is None and plain_markdown("") == ""
    assert plain_markdown("<Note>open\nmore") == "> open\n> more" and plain_markdown("```\nnever closed <Tab>") == "```\nnever closed <Tab>\n```"


def test_markdown_html():
    source = "# T & t\n\npara *one* **two** `a<b`\nnext \\*no\\* [l](http://x) ![i](y)\n\n- a\n- b\n  more\n1. c\n\n> q\n> > r\n\n```py\nx < 1\n```\n---\nend_of_word"
    assert markdown_html(source) == (
        "<h1>T &amp; t</h1>\n<p>para <em>one</em> <strong>two</strong> <code>a&lt;b</code>\nnext *no* <a href=\"http://x\">l</a> <img alt=\"i\" src=\"y\"></p>\n"
        "<ul><li>a</li><li>b more</li></ul>\n<ol><li>c</li></ol>\n<blockquote>\n<p>q</p>\n<blockquote>\n<p>r</p>\n</blockquote>\n</blockquote>\n"
        "<pre><code class=\"language-py\">x &lt; 1\n</code></pre>\n<hr>\n<p>end_of_word</p>"
    )
    assert markdown_html(None) is None and markdown_html("") == "" and markdown_html(">" * 3000 + " x").count("<blockquote>") == 3000
