"""Text functions on literal rows."""

import pytest
from pyspark.sql import functions as F

from panelwerk.functions import text as T
from panelwerk.operators import chains as C
from panelwerk.operators import review as V


def values(spark, rows, make, schema="a string"):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + schema)
    return [r.v for r in sorted(df.select("i", make.alias("v")).collect(), key=lambda r: r.i)]


A, B = F.col("a"), F.col("b")


def test_flatten(spark):
    rows = ["un  testo", "spez-\nzato", "*ANCO-*\n*RA* qui", "*ANCO-*\nRA", "ANCO-\n*RA*", "straße\xa0x", "", None]
    assert values(spark, rows, T.flatten(A)) == ["UN TESTO", "SPEZZATO", "ANCORA QUI", "ANCORA", "ANCORA", "STRASSE X", "", None]
    assert values(spark, rows[2:5], T.flatten(A, True)) == ["*ANCORA* QUI", "*ANCORA*", "*ANCORA*"]


def test_normalize_text(spark):
    assert values(spark, ["Perché  no ?", "pa-\n rola", "“sì”…"], T.normalize_text(A)) == ["PERCHE' NO?", "PAROLA", '"SI\'"...']


def test_to_latin_and_forms(spark):
    assert values(spark, ["ЉУБАВ", "ЂОРЂЕ Џ", "abc"], T.to_latin(A)) == ["LJUBAV", "ĐORĐE DŽ", "abc"]
    assert values(spark, ["TISUĆU", "TKO ZNA", "NETKO I NITKO", "TKOXY"], T.serbian_forms(A)) == ["HILJADU", "KO ZNA", "NEKO I NIKO", "TKOXY"]


def test_clean_output(spark):
    rows = ["```text\nCIAO\n```", "Testo: ciao", '"CIAO"', "«a\n\n b »", "  \n", '"', "a\r\n\r\nb"]
    assert values(spark, rows, T.clean_output(A)) == ["CIAO", "ciao", "CIAO", "a\nb", "", '"', "a\nb"]


def test_fix_punctuation(spark):
    assert values(spark, ["IMMEDIA- TE", "E·LUI", "''A''", "NO!/...", "TU /..."], T.fix_punctuation(A)) == ["IMMEDIA-\nTE", "E'LUI", "'A'", "NO!...", "TU!..."]


def test_tame_repeats(spark):
    assert values(spark, ["S" * 9, "S" * 8, "MA" * 7, "MA" * 6, "!" * 12], T.tame_repeats(A)) == ["SSSS", "S" * 8, "MAMAMA", "MA" * 6, "!!!!"]


def test_case_rules(spark):
    assert values(spark, ["CIAo", "ciao", "12", "", "CIAO я"], T.needs_review(A)) == [False, True, True, True, True]
    assert values(spark, ["CIAo", "ciao", "12"], T.uppercase_lettering(A)) == ["CIAO", "ciao", "12"]
    assert values(spark, [("123", "sfx"), ("123", "speech"), ("Bang!", "sfx")], T.ocr_text(A, B), "a string, b string") == ["", "123", "Bang!"]


def test_not_a_sound(spark):
    assert values(spark, ["una casa nuova", "BANG BANG", "ziiip una due tre", "casa casa una due", "ab cd ef"], T.not_a_sound(A)) == [True, False, False, False, False]


def test_emphasis(spark):
    assert values(spark, ["*a* b *c d*", "* a*", "**"], T.emphasis_count(A)) == [2, 0, 0]
    rows = [("*A* b", "*X* y"), ("*A* b", "X *y* *z*"), ("a", "x * y")]
    assert values(spark, rows, T.keep_emphasis(A, B), "a string, b string") == ["*X* y", "X y z", "x y"]


def test_lengths_and_terms(spark):
    assert values(spark, [("AIUTO", "U POMOĆ MOJA"), ("AIUTO", "U POMOĆ MOJA!!")], T.is_too_long(A, B), "a string, b string") == [False, True]
    assert values(spark, [("ODOH RAMONE", "RAMON"), ("ODOH", "RAMON"), ("VIDIM NORU", "NORA")], T.uses_glossary_term(A, B), "a string, b string") == [True, False, True]


def test_sound_words(spark):
    assert values(spark, ["SWISH", "SHHH", "BANG", "WHACK", "THWACK"], T.adapt_sound(A)) == ["SVIŠ", "ŠŠŠ", "BANG", "VAK", "TVAK"]
    assert values(spark, ["CRAAASH", "SHHH", ""], T.collapsed(A)) == ["CRASH", "SH", ""]
    rows = [("CRAAASH", "CRASH", "KRAŠ"), ("CRASHHH", "CRASH", "KRAŠ"), ("CRRASH", "CRASH", "KRAŠ"), ("AHAAAH", "AHAH", "HAHA"), ("NOOO", "NOO", "NE"), ("UAAU", "UAU", ""), ("CLICKKK", "CLICK", "KLIKKO")]
    assert values(spark, rows, V.stretched(A, B, F.col("c")), "a string, b string, c string") == ["KRAAAŠ", "KRAŠŠŠ", "KRAŠ", "HAHAAA", "NEE", "", "KLIKKOOO"]
    glossary = spark.createDataFrame([(1, "CRASH", "KRAŠ!"), (2, "AH AH AH", "HA-HA-HA!"), (3, "CRAASH", "X")], "id int, source string, target string")
    texts = spark.createDataFrame([(1, "Craaash!! Swish"), (2, "Ah! Ah! Ah!"), (3, "..."), (4, "crash")], "k int, text string")
    found = {r.k: (r.translated, r.proposals) for r in V.sound_translations(texts, glossary, "k").collect()}
    assert found == {1: ("KRAAAŠ!! SVIŠ", ["CRAAASH=KRAAAŠ", "SWISH=SVIŠ"]), 2: ("HA-HA-HA!", []), 3: ("...", []), 4: ("KRAŠ", [])}


def test_words_and_foreign_words(spark):
    assert values(spark, ["Noć, d'Artanjan i Crno-beli x1"], T.words(A)) == [["Noć", "d'Artanjan", "i", "Crno-beli", "x"]]
    assert values(spark, ["tko je točno? TKO", "prijem"], T.non_serbian_words(A)) == [["TKO", "TOČNO"], []]


def test_maybe_continues(spark):
    long = "this is a very long caption that has sixty letters and still goes"
    rows = [("caption", long), ("caption", long + "."), ("speech", long), ("caption", long + "\nJohn Smith"), ("caption", "short")]
    assert values(spark, rows, T.maybe_continues(A, B, F.lit(None)), "a string, b string") == [True, False, False, False, False]


def test_natural_key(spark):
    names = ["p10.jpg", "P2.jpg", "p1.jpg", "a", "p2b", "10", "9", "p" + "9" * 50, "p1" + "0" * 60, "p007"]
    df = spark.createDataFrame([(n,) for n in names], "a string")
    assert [r.a for r in df.orderBy(T.natural_key(A)).collect()] == ["9", "10", "a", "p1.jpg", "P2.jpg", "p2b", "p007", "p10.jpg", "p" + "9" * 50, "p1" + "0" * 60]


@pytest.mark.parametrize(
    ("parts", "joined"),
    [(["A", "B"], "A ‖ B"), (["GIU-", "DIZIO QUI"], "GIUDIZIO ‖ QUI"), (["UNO-", "DUE"], "UNODUE ‖ "), (["UNO-", "1 DUE"], "UNO- ‖ 1 DUE"), (["X"], "X")],
)
def test_chain_text(spark, parts, joined):
    assert values(spark, [(parts,)], C.chain_text(A), "a array<string>") == [joined]


@pytest.mark.parametrize(
    ("translation", "sources", "cut"),
    [
        ("A ‖ B", ["x", "y"], ["A", "B"]),
        ("a b c d", ["xx", "yy"], ["a b", "c d"]),
        ("a", ["xx", "yy"], ["a", ""]),
        ("a b c ‖", ["xxxx", "y"], ["a b", "c"]),
        (" a ‖ b ", ["x"], ["a   b"]),
    ],
)
def test_split_chain(spark, translation, sources, cut):
    assert values(spark, [(translation, sources)], C.split_chain(A, B), "a string, b array<string>") == [cut]


def test_rings_and_shared_tails(spark):
    rows = [(1, 1, 1, 2), (1, 2, 2, 3), (1, 3, 3, None), (1, 4, 4, 3), (1, 5, 5, 6), (1, 6, 6, 5), (1, 7, 7, 99), (2, 8, 1, 1), (1, 9, 8, 9)]
    blocks = spark.createDataFrame(rows, "page_id int, block_id int, position int, continues_id int")
    found = sorted((r.head, r.part, r.block_id) for r in C.resolve_chains(blocks).collect())
    assert found == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (4, 0, 4), (5, 0, 5), (5, 1, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9)]


def test_a_chain_of_a_thousand_links(spark):
    rows = [(1, k, 5000 - k, k + 1) for k in range(1000)] + [(1, 1000, 1, None), (2, 7, 1, 8), (2, 8, 2, 7)]
    found = C.resolve_chains(spark.createDataFrame(rows, "page_id int, block_id int, position int, continues_id int")).collect()
    assert {(r.block_id, r.head, r.part) for r in found if r.page_id == 1} == {(k, 0, k) for k in range(1001)}
    assert {(r.block_id, r.head, r.part) for r in found if r.page_id == 2} == {(7, 7, 0), (8, 7, 1)}


def test_emphasis_mark(spark):
    words = [(0, 0), (0, 1), (1, 1)]
    schema = "a string, b array<struct<row int, `index` int>>"
    assert values(spark, [("UNA CASA QUI\n\nE POI", words), ("X  Y", [(0, 0), (0, 1)])], V.emphasis_mark(A, B), schema) == ["*UNA CASA* QUI\n\nE *POI*", "*X*  *Y*"]


def test_names(spark):
    rows = [("Ramon", "12"), ("Čudo: Šest?", ""), ("", "")]
    assert values(spark, rows, V.album_name(A, B, F.lit("Dom")), "a string, b string") == ["Ramon 12 - Dom", "Čudo Šest - Dom", "- Dom"]
    assert values(spark, rows, V.script_filename(A, B), "a string, b string") == ["ramon-12-scenario.csv", "cudo-sest-scenario.csv", "scenario.csv"]


def test_limits_and_shorter_answers(spark):
    assert values(spark, [(60, True), (512, False)], V.retry_limit(A, B), "a int, b boolean") == [240, 512]
    rows = [("long text", "short"), ("long text", ""), ("same", "size"), ("a", "longer")]
    assert values(spark, rows, V.accept_shorter(A, B), "a string, b string") == ["short", "long text", "same", "a"]


def test_script_is_written_as_csv(spark, tmp_path):
    from panelwerk.sources.manifest import proofreading_script

    rows = [(1, 2, 3, "sound", "a;b", 'c "d"', "draft", "too long"), (2, 1, 1, "speech", "x", "", "untranslated", "")]
    proofreading_script(spark.createDataFrame(rows, "album_id int, page int, position int, kind string, text string, translation string, status string, notes string").coalesce(1), f"{tmp_path}/script")
    files = {p.parent.name: p.read_bytes() for p in tmp_path.glob("script/album_id=*/*.csv")}
    assert set(files) == {"album_id=1", "album_id=2"}
    lines = files["album_id=1"].decode("utf-8").split("\r\n")
    assert lines[0] == "\ufeffpage;block;kind;text;translation;status;notes" and lines[1].startswith('2;3;sound;"a;b";') and lines[1].endswith(";draft;too long")


def test_tables_are_loaded_in_their_types(spark, tmp_path):
    from panelwerk.sources import tables

    spark.createDataFrame([(1, "x", 7)], "album_id int, original_title string, other int").createOrReplaceTempView("some_albums")
    made = tables.conform(spark.table("some_albums"), "albums")
    made.write.parquet(f"{tmp_path}/albums.parquet")
    loaded = tables.load_tables(spark, str(tmp_path), ["albums"])["albums"]
    assert loaded.schema == tables.schema("albums") and loaded.first().album_id == 1 and loaded.first().series_id is None


def test_empty_fields_are_left_out_of_metadata(spark):
    from panelwerk.sources.manifest import album_metadata

    rows = [(1, "S", "", "", "T", "sr", 3), (2, "S", "9", "P", "T", "", 1)]
    albums = spark.createDataFrame(rows, "album_id int, series string, issue_number string, translated_title string, original_title string, target_lang string, page_count int")
    found = [r.metadata for r in album_metadata(albums, "N").orderBy("album_id").collect()]
    assert found == ['{"Series":"S","Title":"T","LanguageISO":"sr","PageCount":"3","Notes":"N"}', '{"Series":"S","Number":"9","Title":"P","LanguageISO":"sr","PageCount":"1","Notes":"N"}']


def test_requests_leave_out_empty_parts(spark):
    blocks = spark.createDataFrame([(1, 1, "sfx", "BANG"), (1, 2, "speech", "A ‖ B"), (2, 1, "title", "T")], "page_id int, number int, kind string, text string")
    pages = spark.createDataFrame([(1, 5, "Notes ", None), (2, 6, None, "")], "page_id int, series_id int, notes string, style string")
    terms = spark.createDataFrame([(1, "X", "Y"), (1, "X", "Y")], "page_id int, source string, target string")
    shown = spark.createDataFrame([(5, 2, "c", "d"), (5, 1, "a", "b")], "series_id int, ord int, source string, target string")
    before = spark.createDataFrame([(1, 1, "last", "L"), (1, 2, "first", "F")], "page_id int, back int, source string, target string")
    found = {r.page_id: (r.numbers, r.prompt) for r in C.build_requests(blocks, pages, terms, shown, before, "Rules.", "Plain.").collect()}
    parts = ["Rules.", "Translation style:\nPlain.", "Notes for this series:\nNotes", "Glossary:\n- X → Y", "Examples:\n- a → b\n- c → d", "Previous page:\n- first → F\n- last → L", "Page to translate:\n1. [sound effect] BANG\n2. [speech] A ‖ B"]
    assert found == {1: (2, "\n\n".join(parts)), 2: (1, "Rules.\n\nPage to translate:\n1. [story title] T")}
    again = {(r.number, r.attempt): r.prompt for r in C.follow_up_requests(blocks.where("number = 2"), pages, terms, shown, before, "Rules.", "Plain.").collect()}
    assert again == {(2, 1): "\n\n".join([*parts[:-1], "Page to translate:\n2. [speech] A ‖ B"]), (2, 2): "\n\n".join([*parts[:4], "Page to translate:\n2. [speech] A ‖ B"])}


def test_outlines(spark):
    good = [[0.0, 0.0], [0.0, 5.0], [0.0, 10.0], [8.0, 10.0], [8.0, 5.0], [8.0, 0.0]]
    rows = [(good,), (good[:4],), (None,), ([*good[:3], *reversed(good[3:])],), ([[0.0, 0.0], [0.0, 5.0], [0.0, 6.0], [8.0, 6.0], [8.0, 5.0], [8.0, 0.0]],)]
    assert values(spark, rows, V.usable_outline(A, F.lit(10.0), F.lit(10.0)), "a array<array<double>>") == [True, False, False, False, False]


def test_apply_translations(spark):
    rows = [(1, 1, "uno due", "", "none"), (1, 2, "tre", "", "none"), (1, 3, "*x* y", "OLD", "approved"), (1, 4, "*a* b", "", "none")]
    blocks = spark.createDataFrame(rows, "page_id int, block_id int, text string, translation string, translation_status string")
    chains = spark.createDataFrame([(1, 1, 1, 0), (1, 1, 2, 1), (1, 3, 3, 0), (1, 4, 4, 0)], "page_id int, head int, block_id int, part int")
    answers = spark.createDataFrame([(1, "JEDAN DVA ‖ TRI", "n"), (3, "NEW", "m"), (4, "A *B* C*", None)], "head int, text string, note string")
    found = {r.block_id: (r.translation, r.translation_status, r.note) for r in C.apply_translations(blocks, chains, answers).collect()}
    assert found == {1: ("JEDAN DVA", "draft", "n"), 2: ("TRI", "draft", None), 3: ("OLD", "approved", None), 4: ("A B C", "draft", None)}
