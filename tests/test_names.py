"""Names: literal cases of readings, mending, English meanings and romanisations."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import names

READINGS = """罗la 森sâm 林lâm 松tùng 安an 娜na 哥ca 布bố 德đức 让nhượng 皮bì 埃ai 尔nhĩ 赫hách 克khắc 诺nặc 黑hắc 龙long 之chi 城thành 火hoả 焰diễm 剑kiếm 派phái 出xuất 所sở 小tiểu 溪khê 清thanh 虚hư 山sơn 副phó 官quan
宁ninh 飞phi 白bạch 衣y 少thiếu|thiểu 女nữ 美mỹ 国quốc 研nghiên 究cứu 院viện 大đại 厦hạ 男nam 主chủ 傲ngạo 天thiên 仓thương 库khố 体thể 育dục 馆quán 迅tấn 雷lôi 幻huyễn 化hoa|hoá 西tây 蒙mông 顿đốn 玛mã 利lợi 亚á 米mễ 兰lan 汉hán 玄huyền 净tịnh 芝chi 加gia 长trường|trưởng"""
TABLE = [(x[0], x[1:].split("|")) for x in READINGS.split()]
SOUNDS = "阿埃艾奥安巴贝布德迪顿尔菲弗赫基克拉莱兰林鲁罗洛玛米蒙娜诺皮萨森斯塔特托维西夏亚雅伊朱让利哥加芝依瑞凯甘"
SURNAMES = "赵钱孙李林罗安白黑华龙汉玄仓宁"


@pytest.fixture(scope="module")
def check(spark):
    table = spark.createDataFrame(TABLE, "char string, readings array<string>")

    def run(rows, **more):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, term string, right string, kind string")
        return names.checked_names(df, table, SOUNDS, SURNAMES, **more).orderBy("id").collect()

    return run


def test_reconcile(check):
    cases = [
        ("罗森", "Lao Sen", "person", "La Sâm"), ("林松", "Lâm Tùng", "person", "Lâm Tùng"), ("安娜", "Anna", "person", "Anna"), ("哥布林", "goblin", "other", "goblin"), ("安德森", "An-đơ-sơn", "person", "An Đức Sâm"), ("让皮埃尔", "Jean-Pierre", "person", "Jean-Pierre"),
        ("赫克诺", "Héc Nơ", "person", "Hách Khắc Nặc"), ("黑龙之城", "Thành Hắc Long", "place", "Thành Hắc Long"), ("火焰剑", "Kiếm Lửa", "item", "Kiếm Lửa"), ("罗㜽", "Gì Đó", "person", "Gì Đó"), (None, "Ai Đó", "person", "Ai Đó"), ("派出所", "đồn cảnh sát", "place", "đồn cảnh sát"),
        ("小溪", "suối nhỏ", "place", "suối nhỏ"), ("清虚山", "núi Thanh Hư", "place", "núi Thanh Hư"), ("副官", "副官", "person", "Phó Quan"), ("宁飞", "Nào Đó", "person", "Ninh Phi"), ("大厦", "Đại hà", "place", "Đại hà"), ("男主", "nam chính", "person", "nam chính"), ("西蒙·埃尔顿", "Simon Elton", "person", "Simon Elton"),
        ("玛利亚", "Maria", "person", "Maria"), ("龙傲天", "Long Aotian", "person", "Long Ngạo Thiên"), ("龙傲天", "Long Ngao Thien", "person", "Long Ngạo Thiên"), ("山长", "Sơn Trưởng", "person", "Sơn Trưởng"), ("林松", None, "person", None), ("林松", "", "person", ""),
    ]
    assert [r["mended"] for r in check([c[:3] for c in cases])] == [c[3] for c in cases]


def test_transliteration_suspect(check):
    cases = [("安娜", "Anna", "person", False), ("罗森", "La Sâm", "person", False), ("白衣少女", "cô gái áo trắng", "person", True), ("美国", "Mỹ", "place", False), ("哥", "ca ca", "person", False), ("研究院", "viện nghiên cứu", "place", False), ("大厦", "Đại hà", "place", True), ("玛利亚", "Maria", "person", False), ("副官", "副官", "person", True), (None, "x", "person", False), ("大厦", "Đại hà", "item", False)]
    assert [r["suspect"] for r in check([c[:3] for c in cases])] == [c[3] for c in cases]


def test_english_meaning(check):
    common = ["game", "computer", "neigong", "intermediate", "level", "high", "magic", "awakening", "stone", "druid"]
    english = [("觉醒石", "Awakening Stone", "item"), ("七班", "Class 7", "sect"), ("魔法高中", "Magic High School", "place"), ("生肉", "Raw Meat Soaked in Zombie Virus", "item"), ("游戏", "game", "other"), ("电脑", "computer", "item"), ("内功", "neigong", "skill"), ("中阶", "Intermediate", "other"), ("生肉", "Shēngròu", "item"), ("1级丧尸", "Level 1 Zombie", "other"), ("第一滴血", "First Blood", "other"), ("以一当百", "One Against a Hundred", "skill")]
    kept = [("觉醒石", "Giác Tỉnh Thạch", "item"), ("龙家", "Long gia", "sect"), ("派出所", "đồn cảnh sát", "place"), ("哥布林", "goblin", "other"), ("安娜", "Anna", "person"), ("托尼·斯塔克", "Tony Stark", "person"), (None, None, None), ("兽人", "orc", "other"), ("德鲁依", "druid", "other"), ("凯瑞甘", "Kerrigan", "person"), ("孟婆汤", "canh Mạnh Bà", "item"), ("哥布林", "Goblin da xanh", "other"), ("丧尸病毒", "Virus zombie", "other"), ("哥哥", "anh trai", "person"), ("伽马射线", "tia gamma", "other"), ("星尘", "Stardust", "item"), ("假面超人", "Cape Man", "other")]
    assert [r["english"] for r in check(english + kept, common=common)] == [True] * len(english) + [False] * len(kept)
    assert [r["english"] for r in check([("游戏", "game", "other"), ("七班", "Class 7", "sect")])] == [False, True]


def test_romanised(spark):
    pinyin = {"仓": "cang", "库": "ku", "体": "ti", "育": "yu", "馆": "guan", "迅": "xun", "雷": "lei", "幻": "huan", "化": "hua", "安": "an", "娜": "na", "米": "mi", "兰": "lan", "汉": "han", "森": "sen", "玄": "xuan", "净": "jing", "芝": "zhi", "加": "jia", "哥": "ge"}
    rows = [("仓库", "Cangku", "place", "Thương Khố"), ("体育馆", "Tiyuguan", "place", "Thể Dục Quán"), ("迅雷", "Xunlei", "other", "Tấn Lôi"), ("幻化", "Huan Hua", "skill", "Huyễn Hoa"), ("安娜", "Anna", "other", None), ("米兰", "Milan", "other", None), ("汉森", "Hansen", "person", None), ("仓库", "Thương Khố", "place", None), ("芝加哥", "Chicago", "place", None), ("玄净", "Xuanjing", "person", None)]
    df = spark.createDataFrame([(i, t, r, k, [pinyin[c] for c in t]) for i, (t, r, k, _) in enumerate(rows)], "id long, t string, r string, k string, p array<string>")
    df = df.withColumn("rd", names.readings_of(spark.createDataFrame(TABLE, "char string, readings array<string>"))(F.col("t")))
    t, r, k, rd, p = (F.col(c) for c in ("t", "r", "k", "rd", "p"))
    got = df.select("id", names.pinyin_written(t, r, k, rd, p, SOUNDS).alias("w"), names.pinyin_suspect(t, r, rd, p, SOUNDS).alias("s")).orderBy("id").collect()
    assert [x["w"] for x in got] == [x[3] for x in rows] and [i for i, x in enumerate(got) if x["s"]] == [0, 1, 2, 3, 6, 9]


def test_small_rules(spark):
    df = spark.createDataFrame([(" Goblin ",), ("robot",), (None,)], "w string")
    assert [r[0] for r in df.select(names.is_loanword(F.col("w"))).collect()] == [True, False, False]
    words = spark.createDataFrame([(w,) for w in ("nghieng", "xanh", "trai", "ba", "stone", "zoa", "quyen", "sam")], "w string")
    assert [r[0] for r in words.select(names.is_syllable(F.col("w"), ["zoa"])).collect()] == [True, True, True, True, False, True, True, True]
    rd = spark.createDataFrame([([["la", "lạ"], ["sâm", "sầm"], ["a"]],), ([["la"], []],), ([],), (None,)], "r array<array<string>>")
    assert [r[0] for r in rd.select(names.reading_candidates(F.col("r"), 3)).collect()] == [["La Sâm A", "La Sầm A", "Lạ Sâm A"], [], [], None]
