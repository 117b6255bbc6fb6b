"""Menu parsing: line formats, and blocks against one big window."""

from pourscale.operators import menu as m

TEXT = """REDS
Alpha Estate Merlot 2019 145
Beta House Blanc 16/28
irpinia, italy 2019
Gamma Hall Rouge 14/22/75
Delta Winery,
Napa Valley
2015 90
Epsilon Manor 2018
120
BY THE GLASS
Zeta Court 12
HALF BOTTLES
Eta Grove 60
MAGNUM
Theta Park 300"""


def entries(spark, text, menu=1):
    lines = m.scan_menu_text(spark.createDataFrame([(menu, text)], "menu_id int, content string"))
    rows = m.parse_menu(lines).orderBy("line_no", "sub").collect()
    return [(r["desc"], r["vintage"], float(r["menu_price"])) for r in rows]


def test_line_formats(spark):
    assert entries(spark, TEXT) == [
        ("Alpha Estate Merlot", 2019, 145.0),
        ("Beta House Blanc (by glass)", 2019, 80.0),
        ("Gamma Hall Rouge", None, 75.0),
        ("Delta Winery Napa Valley", 2015, 90.0),
        ("Epsilon Manor", 2018, 120.0),
        ("Zeta Court (by glass)", None, 60.0),
        ("Eta Grove (half btl)", None, 120.0),
        ("Theta Park (magnum ÷2)", None, 150.0),
    ]


def test_one_big_menu_gives_the_same_entries_in_small_blocks(spark, monkeypatch):
    words = ["Anvil", "Bolt", "Gear", "Plate", "Widget", "Ring", "Gizmo"]
    text = "\n".join(
        TEXT.replace("Estate", words[i % 7] + chr(97 + i // 7) * 3).replace("House", words[i % 5] + chr(97 + i // 5) * 3)
        for i in range(12)
    )
    whole = entries(spark, text)
    monkeypatch.setattr(m, "BLOCK", 7)
    assert entries(spark, text) == whole and len(whole) > 20
