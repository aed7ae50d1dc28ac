import pytest

from quarrylens.llm import mojibake as M

DE = "Größere Änderungen müssen für die Prüfung häufiger geklärt werden – „schön“ kostet 5 €."
FR = "Après relecture, la clé secrète a été mesurée à l’été ; où est le modèle léger ?"
RU = "Проверка модели остановилась после прошлого запуска, подпись меняется."
ZH = "水印检测在样本之后停止，编码器需要重新校准。"
PL = "Zażółć gęślą jaźń, źródło wartości; łączność się zmieniła."
EL = "Ελλάδα είναι μια χώρα με ωραία νησιά."
TR = "Şimdi değişen çağrı için yeni bir ışık gerekir."
RUN = "Run filter-cradle-1997: blocks=521 embedded=926 z=1.581 0.13"
PLAIN = [DE, FR, RU, ZH, "Ångström-Maß: 83 Å; ÖFFNEN → SCHLIESSEN; ├── a │ └── b", "NÃO É ÂNCORA; Ã e Â são vogais", "z = (h − γ·n) / √n ≈ 0.8", "plain text", "", None, PL, EL, TR, RUN, "l’été c’était voilà léger; “gut” dit-il, Er sagte gut"]


def read_as(text, wrong, true="utf-8"):
    return text.encode(true).decode(wrong, errors="replace")


DAMAGE = {
    "latin-1": read_as(DE, "latin-1"),
    "twice": read_as(read_as(FR, "latin-1"), "latin-1"),
    "cp437": read_as(FR, "cp437"),
    "mac": read_as(DE, "mac-roman"),
    "cyrillic": read_as(RU, "latin-1", "cp1251"),
    "koi8": read_as(RU, "cp1251", "koi8-r"),
    "chinese": read_as(ZH, "latin-1", "gb18030"),
    "wide": "Every block gets its own signature here".encode().decode("utf-16-le", errors="replace"),
    "part": f"{DE} Und dann: {read_as('Möglicherweise für später', 'latin-1')} Ende.",
    "lost": "Apr\ufffds relecture, la cl\ufffd secr\ufffdte",
    # sound and damaged characters in one run; a lost byte; a no-break space that became a blank
    "mixed run": "c’était l’" + read_as("été", "latin-1"),
    "lost byte": read_as("Er sagte „gut“ und “gut”", "cp1252"),
    "blank": f"{read_as('léger voilà', 'cp1252')} le".replace("\xa0", " "),
    "three times": read_as(read_as(read_as(FR, "latin-1"), "latin-1"), "latin-1"),
    "greek": read_as(EL, "latin-1", "iso-8859-7"),
    "polish": read_as(PL, "latin-1", "iso-8859-2"),
    "turkish": read_as(TR, "latin-1", "iso-8859-9"),
    "chinese lost": read_as(ZH, "gb18030"),
    "one letter": "Gr\ufffdßere Änderungen m\ufffdssen, Про\ufffdерка моде\ufffdи",
    "ascii": "Après relecture, l’été".encode().decode("ascii", errors="replace"),
    "figures": RUN.encode().decode("utf-16-le"),
}
RESTORED = {"latin-1": DE, "twice": FR, "cp437": FR, "mac": DE, "cyrillic": RU, "koi8": RU, "chinese": ZH, "lost": "Après relecture, la clé secrète"}
RESTORED |= {"mixed run": "c’était l’été", "lost byte": "Er sagte „gut“ und “gut”", "blank": "léger voilà le", "three times": FR, "greek": EL, "polish": PL, "turkish": TR, "chinese lost": ZH}
RESTORED |= {"one letter": "Größere Änderungen müssen, Проверка модели", "ascii": "Après relecture, l’été", "figures": RUN}


@pytest.fixture(scope="module")
def got(spark):
    rows = [(i, t, "clash") for i, t in enumerate(PLAIN * 30)] + [(10_000 + i, t, "") for i, t in enumerate(["Möglicherweise für später", "Every block gets its own signature here"] * 20)]
    rows += [(20_000 + i, t, "") for i, t in enumerate(DAMAGE.values())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start string")
    spans = M.damage(df)
    return {r.doc_id: r for r in M.restore(df, spans).collect()}


def test_no_plain_text_is_touched(got):
    assert all(k >= 20_000 for k in got)


@pytest.mark.parametrize("n, name", list(enumerate(DAMAGE)))
def test_damage_is_found_and_restored(got, n, name):
    assert 20_000 + n in got
    if name in RESTORED:
        assert got[20_000 + n].restored == RESTORED[name]
        assert got[20_000 + n].n_unrestored == 0
    if name == "part":
        assert got[20_000 + n].restored == f"{DE} Und dann: Möglicherweise für später Ende."


def test_edges(spark):
    for rows in ([], [(1, None)], [(1, "")], [(1, "a" * 200_000)], [(1, "é" * 50_000)]):
        assert M.damage(spark.createDataFrame(rows, "doc_id bigint, text string")).count() == 0
    assert M.damage(spark.createDataFrame([(1, "x \ufffd y")], "doc_id bigint, text string")).count() == 1


def test_viterbi_keeps_to_a_channel():
    # gains over the token as it stands: the middle one alone would take the other channel
    a, b = "utf-8 as mac-roman", "utf-8 as cp850"
    places = [(0, 1, "x", [(a, 20.0, "1")]), (2, 3, "y", [(a, 1.0, "2"), (b, 1.1, "3")]), (4, 5, "z", [(b, 5.0, "4")])]
    assert [(s, c) for s, _, c, _ in M.viterbi(places, 6.0)] == [(0, a), (2, a)]
    assert M.viterbi([(0, 3, "a\ufffdb", [])], 6.0) == [(0, 3, "lost", None)]
    # equal paths: the first channel of the table
    assert M.viterbi([(0, 1, "x", [("utf-8 as iso-8859-15", 9.0, "r"), ("utf-8 as windows-1252", 9.0, "r")])], 6.0)[0][2] == "utf-8 as windows-1252"


def test_what_stays_lost_is_counted(spark):
    rows = [(i, t) for i, t in enumerate([DE, FR] * 20)] + [(100, "cost 370 \ufffd per batch"), (101, "\ufffd\ufffd\ufffd \ufffd"), (102, "m\ufffdssen \ufffd")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.restored, r.n_unrestored) for r in M.restore(df, M.damage(df)).collect()}
    assert got == {100: (rows[40][1], 1), 101: (rows[41][1], 2), 102: ("müssen \ufffd", 1)}
