import random

import pytest

from lodestone.sources import songbook as S


@pytest.mark.parametrize(
    ("text", "want"),
    [("그리드맨 유니버스 UNION", "UNION"), ("돌아가는 펭귄  少年よ", "少年よ"), ("UNION", "UNION"), ("가나다", ""), ("A 가나 B 다 C", "B 다 C"), ("", "")],
)
def test_after_hangul(text, want):
    assert S.after_hangul(text) == want


def test_title_of():
    assert S.title_of("애니    タイトル") == "タイトル"
    assert S.title_of("애니 이름 UNION") == "UNION"
    assert S.title_of("애니 이름") == "" and S.title_of("") == ""
    assert S.title_of("X    애니 ゴースト") == "ゴースト"


def book(spark, lines):
    df = spark.createDataFrame([("b", i, x) for i, x in enumerate(lines)], "book string, line_no long, line string")
    return {r.tj: (r.title, r.artist, r.title_ko, r.artist_ko, r.section) for r in S.parse(df.repartition(3), ["book"]).collect()}


def test_sections_and_columns(spark):
    lines = [
        "2026년 02월    26000   x",
        "애니메이션       夢の歌              ★  27001   歌う人",
        "                 유메노우타              우타우히토",
        "보컬로이드,       1925   28000  冨田",
        "특촬물  Alive A Life     28526  松本",
        "                                마츠모토",
    ]
    got = book(spark, lines)
    assert got == {
        "27001": ("夢の歌", "歌う人", "유메노우타", "우타우히토", "anime"),
        "28000": ("1925", "冨田", None, None, "vocaloid"),
        "28526": ("Alive A Life", "松本", None, "마츠모토", "anime"),
    }


def test_wraps(spark):
    lines = [
        "애니    Song One               27100   Fear, and Loathing",
        "",
        "                                       in Las Vegas",
        "애니    Song Two               27101   東京",
        "오버런!                                ★  事変",
        "                                       楽団",
        "                                       more",
        "애니    Song Three             27102",
        "                               27103   x",
    ]
    got = book(spark, lines)
    assert got["27100"][1] == "Fear, and Loathing in Las Vegas"
    assert got["27101"][1] == "東京事変楽団" and got["27103"][:2] == ("", "x") and "27102" not in got
    df = spark.createDataFrame([("b", i, x) for i, x in enumerate(lines)], "book string, line_no long, line string")
    assert [r.caveat for r in S.caveats(S.read(df, ["book"])).collect()] == ["L7: empty artist for code 27102"]


def test_each_column_is_used_once():
    near = [S.Cell(10, "가"), S.Cell(14, "나")]
    assert S.assign(near, "夢", 12, "人", 12) == ("가", "나")
    assert S.assign(near[:1], "夢", 12, "人", 12) == ("가", None)
    assert S.assign([S.Cell(60, "가")], "夢", 3, "歌う", 30) == ("가", None)
    assert S.assign([S.Cell(60, "가")], "夢の歌", 3, "人", 30) == (None, "가")
    assert S.assign([], "夢", 1, "人", 2) == (None, None) and S.assign(near, "Latin", 10, "Latin", 14) == (None, None)


def test_any_line_gives_a_row_or_none(spark):
    rng = random.Random(5)
    parts = ["    ", "  ", " ", "가나", "夢", "ab", "27001", "28000", "★", ",", "보컬로이드,", "12", "1.5000"]
    lines = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(400)] + [None, ""]
    got = book(spark, lines)
    assert all(t[1] and t[4] in ("anime", "vocaloid") for t in got.values()) and got
    assert book(spark, []) == {}
