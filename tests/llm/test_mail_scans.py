import random

import pytest

from quillmesh.llm import mail, scans


def own(text):
    lines = text.split("\n")
    return [lines[k - 1] for k in mail.authored_lines(text)]


CASES = {
    "top": ("Subject: x\nHi Ann,\n\nnew text here.\n\nRegards,\nBob\n-- \nBob Smith\nDesk\nT +00 1\n\nOn 8 Feb 2022 at 01:45, Ann <ann@x.example> wrote:\n> old\n> text", ["Hi Ann,", "new text here."]),
    "interleaved": ("On 8 Feb 2022 at 01:45, Ann <ann@x.example> wrote:\n> question one\n\nanswer one.\n\n> question two\nAnswer two is here.\nIt has two lines.\n> and more", ["answer one.", "Answer two is here.", "It has two lines."]),
    "lost mark": ("Ann Lee writes:\n> a long line that was\nwrapped by the mailer\n> goes on\n\nreply.", ["reply."]),
    "original": ("Done.\n\n-----Original Message-----\nFrom: Ann\nSent: 1.1.2020\nTo: Bob\nSubject: y\n\nplease do\n> older", ["Done."]),
    "headers": ("Gut.\n\nVon: Ann\nGesendet: 1.1.2020\nAn: Bob\nBetreff: y\n\nbitte", ["Gut."]),
    "forward": ("FYI.\n\nBegin forwarded message:\n\nFrom: A\nTo: B\n\ntext", ["FYI."]),
    "indented": ("Sí.\n\nEl 20 sep 2023 a las 05:06, I K <i@f.example> escribió:\n    Hola\n\n    ¿Qué?", ["Sí."]),
    "wrapped intro": ("Ja.\n\nIlemi Quarides <i.q@h.example> schrieb am\n22.1.2022:\n> alt", ["Ja."]),
    "initials": ("Yes.\n\nOn Apr 28, 2023, at 20:57, Velta wrote:\n\nVV> old\nVV> lines", ["Yes."]),
    "decoys": ("-- but that is only my impression --\nFrom: the second paragraph on, it differs.\nOriginal message counts are in the sheet.\nAs the clerk wrote: nothing is final.\nOn Monday I wrote to you again.", ["-- but that is only my impression --", "From: the second paragraph on, it differs.", "Original message counts are in the sheet.", "As the clerk wrote: nothing is final.", "On Monday I wrote to you again."]),
    "prompt": ("Type this:\n> run --now\nThen wait.", ["Type this:", "> run --now", "Then wait."]),
    "legal": ("Text.\n\nThis message and any attachment are intended for the addressee only and may be privileged.", ["Text."]),
    "heading": ("Text.\n\nCONFIDENTIALITY NOTICE\nIf you have received this transmission in error, delete it.", ["Text."]),
    "program": ("Text.\n\nSent from my phone", ["Text."]),
    "closing at once": ("Text.\nthx\nBob", ["Text."]),
    "piped signature": ("Text.\n\nRgds,\nBob Smith | Desk | T +00 1 22", ["Text."]),
    "quote only": ("> a\n> b", []),
    "crlf": ("Hi,\r\ntext.\r\n-- \r\nBob\r\n", ["Hi,\r", "text.\r"]),
    "garbled": ("Subject: x\nGrÃ¼ÃŸ Gott,\n\nText.\n\nMit freundlichen GrÃ¼ÃŸen\nBob", ["GrÃ¼ÃŸ Gott,", "Text."]),
    "lossy intro": ("Oui.\n\nLe 9 ao??t 2021 ?? 16:46, M F <m@i.example> a ??crit :\n> vieux", ["Oui."]),
}


@pytest.mark.parametrize("name", list(CASES))
def test_own_lines(name):
    text, expected = CASES[name]
    assert own(text) == expected


def test_tree_is_recursive():
    nested = ["Ann Lee writes:", "> Hi", "> On 8 Feb 2022 at 01:45, Bob <b@x.example> wrote:", ">> deep", ">>> deeper", ">", "> Bye now.", "", "end."]
    kinds = mail.line_kinds("\n".join(nested))
    assert kinds == [(1, "introduction", 0), (2, "authored", 1), (3, "introduction", 1), (4, "authored", 2), (5, "authored", 3), (6, "quote", 0), (7, "authored", 1), (9, "authored", 0)]
    tree = mail.parse(nested)
    assert [n.kind for n in tree] == ["quote", "authored"] and [c.kind for c in tree[0].children] == ["authored", "quote", "authored"]
    forward = "See below.\n\n-----Original Message-----\nFrom: Ann\nTo: Bob\n\nMine.\n\nBegin forwarded message:\n\nTheirs.\n> old"
    assert [(k, d) for _, k, d in mail.line_kinds(forward)][-3:] == [("introduction", 1), ("authored", 2), ("authored", 3)]


@pytest.mark.parametrize("text", [">" * 300_000 + " x", "\n".join(">" * k + " line" for k in range(1, 700)), "-----Original Message-----\n" * 5000, "> a\nb\n" * 20_000, "> > " * 50_000])
def test_deep_and_long_quotes_end(text):
    assert mail.authored_lines(text) == [] or set(mail.authored_lines(text)) < set(range(1, text.count("\n") + 2))
    assert {n for n, _, _ in mail.line_kinds(text)} == {k + 1 for k, line in enumerate(text.split("\n")) if line.strip()}


def test_mail_table(spark):
    rows = [(1, " a.EML ", "Hi.\n> x"), (2, "b.msg", None), (3, "c.txt", "Hi."), (4, None, "Hi."), (5, "d.eml", ""), (6, "e.eml", "  \n "), (7, "f.Msg", "line\n" * 20_000), (1, " a.EML ", "Hi.\n> x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id int, file_name string, page_content string, line_no int")
    got = mail.newly_written(df).collect()
    assert sorted((r.id, r.line_no) for r in got if r.id != 7) == [(1, 1), (1, 1)] and sum(r.id == 7 for r in got) == 20_000
    assert mail.newly_written(df.where("false")).count() == 0


_DRAW = random.Random(12)
WORDS = sorted({"".join(_DRAW.choice(["con", "ta", "re", "mi", "lec", "do", "ver", "sta", "bu", "no", "cor", "an", "gel", "ti", "fra", "ous"]) for _ in range(_DRAW.randrange(2, 5))) for _ in range(700)})


def clean_records(n=600):
    draw = random.Random(9)
    return [(k, "x.txt", " ".join(draw.choice(WORDS) for _ in range(120)) + " well-known") for k in range(n)]


def scanned_page(draw, width=48):
    """A page set in lines, with what was done to it: {line number: kinds}."""
    words = [draw.choice(WORDS) for _ in range(140)]
    lines, line, marks = ["Harbour Office", ""], "", {1: {"furniture"}}
    broken = 0
    for w in words:
        if len(line) + len(w) + 1 > width:
            cut = width - len(line) - 2
            if 3 <= cut <= len(w) - 3:
                lines.append(f"{line} {w[:cut]}-".strip())
                marks.setdefault(len(lines), set()).add("hyphen")
                line = w[cut:]
                continue
            lines.append(line)
            line = ""
        if broken < 8 and "c" in w[1:] and draw.random() < 0.2:
            k = w.index("c", 1)
            w = w[:k] + "(" + w[k + 1 :]
            broken += 1
            line = f"{line} {w}".strip()
            marks.setdefault(len(lines) + 1, set()).add("misread")
            continue
        line = f"{line} {w}".strip()
    lines.append(line + ".")
    lines.append("- 7 -")
    marks[len(lines)] = {"furniture"}
    return lines, marks


def test_scans(spark):
    draw = random.Random(3)
    first, marks = scanned_page(draw)
    second, more = scanned_page(draw)
    second[-1] = "- 8 -"
    text = "[[page1]]" + "\n".join(first) + "\n[[page2]]" + "\n".join(second)
    expected = {(n, k) for n, kinds in marks.items() for k in kinds} | {(n + len(first), k) for n, kinds in more.items() for k in kinds}
    rows = [*clean_records(), (1000, "s.pdf", text), (1001, "s.pdf", None), (1002, "s.pdf", ""), (1003, None, "one line"), (1004, "m.eml", text), (1000, "s.pdf", text)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id int, file_name string, page_content string, kind string")
    got = [(r.id, r.line_no, r.kind) for r in scans.scan_lines(df).collect()]
    assert {i for i, _, _ in got} == {1000} and len(got) == 2 * len(set(got))
    found = {(n, k) for _, n, k in got}
    assert len(found & expected) >= 0.95 * len(expected) and len(found - expected) <= 0.05 * len(expected), (found - expected, expected - found)
    fixed = {r.id: r.repaired for r in scans.repaired(df).collect()}[1000]
    assert "Harbour Office" not in fixed and "- 7 -" not in fixed and "(" not in fixed
    assert all(w.strip(".") in WORDS for w in fixed.split()), [w for w in fixed.split() if w.strip(".") not in WORDS]


def test_no_records(spark):
    df = spark.createDataFrame([], "id int, file_name string, page_content string")
    assert scans.scan_lines(df).count() == 0 and scans.repaired(df).count() == 0


def test_held_out_words():
    """The editor on damaged words it wasn't trained on, and on clean ones it doesn't know."""
    draw = random.Random(1)
    letters = "etaoinshrdlucmfwgypbvk"
    vocabulary = {"".join(draw.choices(letters, weights=range(len(letters), 0, -1), k=draw.randrange(4, 11))): draw.randrange(100, 3000) for _ in range(3000)}
    lexicon = scans.Lexicon(dict(vocabulary), sum(vocabulary.values()))
    repairer = scans.Repairer(lexicon, scans.Editor().train(lexicon))
    unknown = ["".join(draw.choices(letters, weights=range(len(letters), 0, -1), k=8)) for _ in range(300)]
    assert sum(repairer.word(w)[1] >= 0 for w in unknown if w not in vocabulary) <= 15
    right = tried = 0
    for word in draw.sample(sorted(vocabulary), 400):
        hits = [(p, r) for p, r in scans.MISREADINGS if p in word and (word.replace(p, r, 1)) not in vocabulary]
        if hits:
            p, r = draw.choice(hits)
            tried += 1
            right += repairer.word(word.replace(p, r, 1))[0].lower() == word
    assert right >= 0.9 * tried


def test_running_lines_far_apart():
    draw = random.Random(5)
    lines, footers = [], []
    for n in range(14):
        body = [f"{'[[page%d]]' % (n + 1) if not k else ''}" + " ".join("".join(draw.choices("abcdefghilmnoprstu", k=6)) for _ in range(8)) for k in range(7)]
        lines += body
        if n in (1, 12):
            footers.append(len(lines))
            lines.append("Harbour Office" if n == 1 else "Harb0ur Off1ce")
    assert scans.furniture(lines) == set(footers)


def test_running_lines_against_brute_force():
    draw = random.Random(6)
    base = ["".join(draw.choices("abcdef #", k=draw.randrange(1, 30))) for _ in range(12)]
    forms = []
    for _ in range(240):
        form = list(draw.choice(base))
        for _ in range(draw.randrange(5)):
            form[draw.randrange(len(form))] = draw.choice("abcdefxyz")
        forms.append("".join(form))
    zones = [[3 * n, 3 * n + 1, 3 * n + 2] for n in range(80)]
    running = scans._Running(dict(enumerate(forms)), zones)
    for k, form in enumerate(forms):
        assert running.repeated(k, k // 3) == (len(form) > 2 and any(scans._alike(form, forms[j]) for j in range(240) if j // 3 != k // 3)), form


def test_wide_lines_dont_hide_the_width():
    draw = random.Random(3)
    lines, _ = scanned_page(draw)
    width = scans.wrapped_width(lines)
    assert width and scans.wrapped_width([*lines, "x" * 131]) == width == scans.wrapped_width(["A TITLE OF MORE CHARACTERS THAN THE LINES BELOW IT HOLD " * 3, "", *lines])
    assert scans.wrapped_width(["a paragraph in one line " * 20, "another one in one line " * 31, "and so on " * 40] * 5) == 0
    assert scans.wrapped_width(["BG 88048", "VL/93444", "AZ-58723"] * 80) == 0


def test_line_ends_on_held_out_words():
    """Joins decided by the editor on words it wasn't trained on, known and unknown."""
    draw = random.Random(4)
    make = lambda: "".join(draw.choices("etaoinshrdlucm", k=draw.randrange(5, 11)))
    vocabulary = {make(): draw.randrange(100, 3000) for _ in range(2500)}
    firsts = draw.sample(sorted(vocabulary), 60)
    hyphened = {f"{draw.choice(firsts)}-{draw.choice(sorted(vocabulary))}": draw.randrange(100, 400) for _ in range(300)}
    lexicon = scans.Lexicon(vocabulary | hyphened, sum(vocabulary.values()))
    repairer = scans.Repairer(lexicon, scans.Editor().train(lexicon))
    words = draw.sample(sorted(vocabulary), 300)
    assert sum(repairer.divided(w[:k], w[k:], "-") for w in words for k in (2, 3)) >= 0.99 * 600
    assert sum(repairer.divided(*w.split("-"), "-") for w in hyphened) <= 3
    unknown = [make() for _ in range(300)]
    assert sum(repairer.divided(w[:3], w[3:], "-") for w in unknown if w not in vocabulary) >= 270
    assert not repairer.divided("Karin", "Lindholm", "-") or "karin" not in vocabulary


@pytest.mark.parametrize("operator", ["scan_lines", "repaired"])
def test_rare_words_by_a_join(spark, data_dir, operator, monkeypatch):
    """The same rows whether the lexicon is broadcast whole or the rarer words come by a join."""
    df = spark.read.parquet(f"{data_dir}/document_metadata.parquet")
    monkeypatch.setattr(scans, "RARE", 1e-3)
    whole = getattr(scans, operator)(df).collect()
    monkeypatch.setattr(scans, "LEXICON", 1)
    assert scans.fit(df)[1].count() > 100
    assert sorted(map(tuple, getattr(scans, operator)(df).collect())) == sorted(map(tuple, whole))


def test_structure_table(spark):
    rows = [(1, "a.eml", "Hi.\n> x\n\n>> y"), (2, "b.msg", None), (3, "c.txt", "Hi."), (4, "d.eml", " \n"), (None, "e.eml", "Hi."), (1, "a.eml", "Hi.\n> x\n\n>> y")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "id int, file_name string, page_content string, depth int, kind string")
    got = sorted((r.id or 0, r.line_no, r.kind, r.depth) for r in mail.structure(df).collect())
    assert got == [(0, 1, "authored", 0), *sorted([(1, 1, "authored", 0), (1, 2, "authored", 1), (1, 4, "authored", 2)] * 2)]
    assert mail.structure(df.where("false")).count() == 0
