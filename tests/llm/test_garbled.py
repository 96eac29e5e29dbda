import pytest

from quillmesh.llm import garbled as g

TEXTS = {
    "de": "Über die Böschung berät der Ausschuss größtenteils. Früher verkürzt das Förderband die Straße, obwohl die Gebühr fehlt.",
    "fr": "Où la référence précède le siège, l'élément révèle déjà très tôt la façade. Ça achève le côté gauche, l'évêché répète.",
    "es": "¿Por qué la compañía confirmó el préstamo? ¡Atención! Según el trámite, la sesión amplió mañana el párrafo y el año.",
    "pl": "Według spółki źródło zgłasza później załącznik. Jeżeli część wyjaśnia pamięć, ścieżka łączy żądanie.",
    "ru": "По словам свидетеля, заявление позднее описывает пошлина. Если отчёт исключает договор, поиск нарушает словарь ежедневно.",
    "el": "Όταν η απόφαση επαναλαμβάνει η μετάφραση, η γέφυρα καθημερινά περιγράφει ο φάκελος. Στη σελίδα το τμήμα περιέχει ο μάρτυρας.",
}
CLEAN = [*TEXTS.values(), "Plain English text with numbers 12.5 and codes AB-1234.", "“quoted” — £5, 20 °C, § 7, © 1999, ½ mile, naïve café… it’s", "SÃO PAULO: ATENÇÃO, a ÂNCORA", "L'ACCÈS À L'ÉVÊCHÉ", "emoji 👩‍💻 📄", "", None, "m² and 5 m³", "a divi­\nded word, another divi¬\nded one"]


def misread(text, written, read):
    out = []
    for b in text.encode(written, "ignore"):
        try:
            out.append(bytes([b]).decode(read))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.mark.parametrize("text", [t for t in CLEAN if t])
def test_clean_text_is_left_alone(text):
    assert not g.is_garbled(text) and g.restore(text) is text


def test_nothing_to_do():
    assert not g.is_garbled(None) and not g.is_garbled("") and g.restore(None) is None


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "cp1250", "cp1251", "koi8-r", "cp437", "cp850", "mac_roman"])
@pytest.mark.parametrize("language", list(TEXTS))
def test_utf8_read_as_another(language, read):
    text = TEXTS[language]
    wrong = misread(text, "utf-8", read)
    assert g.is_garbled(wrong) and g.restore(wrong) == text


@pytest.mark.parametrize("language", ["de", "fr", "es", "pl"])
def test_twice(language):
    text = TEXTS[language]
    wrong = misread(misread(text, "utf-8", "cp1252"), "utf-8", "cp1252")
    assert g.is_garbled(wrong) and g.restore(wrong) == text


@pytest.mark.parametrize(
    "language,written,read",
    [("de", "cp1252", "mac_roman"), ("fr", "cp1252", "mac_roman"), ("fr", "mac_roman", "cp1252"), ("es", "cp1252", "cp437"), ("fr", "cp1252", "cp437"), ("de", "cp1252", "cp1251"), ("fr", "cp1252", "cp1251"), ("pl", "cp1250", "cp1252"), ("ru", "koi8-r", "cp1252"), ("ru", "cp1251", "latin-1"), ("ru", "koi8-r", "cp1251"), ("ru", "cp1251", "koi8-r"), ("el", "cp1253", "cp1252")],
)
def test_single_byte_pairs(language, written, read):
    text = TEXTS[language]
    wrong = misread(text, written, read)
    assert g.is_garbled(wrong)
    fixed = g.restore(wrong)
    right = sum(a == b for a, b in zip(fixed.split(), text.split()))
    assert right >= 0.9 * len(text.split()), fixed


def test_stretch_in_correct_text():
    text = f"{TEXTS['de']} {misread(TEXTS['fr'], 'utf-8', 'cp1252')} {TEXTS['es']}"
    assert g.restore(text) == f"{TEXTS['de']} {TEXTS['fr']} {TEXTS['es']}"


def test_entities_and_wide():
    wrong = misread("compañía", "utf-8", "latin-1").replace("Ã", "&Atilde;").replace("±", "&plusmn;")
    assert g.is_garbled(wrong) and g.restore(wrong) == "compañía"
    assert not g.is_garbled("AT&amp;T and &eacute;t&eacute;")
    assert g.restore("référence".encode().decode("gbk")) == "référence"
    assert not g.is_garbled("日本語の索引")


def test_lossy():
    assert g.is_garbled("l�scht") and g.is_garbled("el tel??fono") and g.is_garbled("Le 14 ao??t")
    assert not g.is_garbled("Really?? Yes. Is it so?") and not g.is_garbled("see x.example/a?b=c")


def test_lines_hold():
    text = "\n".join(TEXTS.values()) + "\r\n\n"
    wrong = misread(text, "utf-8", "cp1252")
    assert g.restore(wrong).count("\n") == text.count("\n")


def test_tables(spark):
    rows = [(1, "faÃ§ade"), (2, "façade"), (3, None), (4, ""), (5, "x" * 300_000 + " �"), (6, "ascii"), (1, "faÃ§ade")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id int, page_content string, restored int")
    assert sorted(r.id for r in g.garbled(df).collect()) == [1, 1, 5]
    assert {r.id: r.restored for r in g.restored(df).collect()}[1] == "façade"
    assert g.garbled(df.where("false")).count() == 0


def test_lossy_behind_a_capital(spark):
    df = spark.createDataFrame([(1, "F?r alle"), (2, "Das B?ro ist zu"), (3, "Is it so?"), (4, "see x.example/a?b=c")], "id int, page_content string")
    assert sorted(r.id for r in g.garbled(df).collect()) == sorted(r.id for r in g.restored(df).collect()) == [1, 2]


def test_long_words_are_judged_in_pieces():
    assert max(map(len, g._suspects("é" * 1000))) <= g.LONGEST


def test_long_text_without_blanks():
    """A megabyte without a blank is judged piece by piece, in time linear in its length."""
    import random
    import time

    draw = random.Random(2)
    words = TEXTS["de"].split() + TEXTS["fr"].split()
    text = "".join(draw.choice(words) for _ in range(20_000))
    seconds = []
    for part in (text[: len(text) // 4], text):
        wrong = misread(part, "utf-8", "cp1252")
        began = time.perf_counter()
        assert g.is_garbled(wrong) and sum(a == b for a, b in zip(g.restore(wrong), part)) > 0.99 * len(part)
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 8 * seconds[0] + 1


def test_every_pair_is_in_the_automaton():
    sequences = g.garbled_sequences()
    for number, (written, read) in enumerate(g.pairs()):
        wrong = misread("ö" if written not in ("cp1251", "koi8-r", "cp866", "iso8859-5", "cp1253", "iso8859-7") else "ж" if "12" not in written[-2:] and written not in ("cp1253", "iso8859-7") else "λ", written, read)
        if wrong and wrong not in ("ö", "ж", "λ"):
            assert number in sequences.get(wrong, {}), (written, read, wrong)
