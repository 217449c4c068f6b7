import pyarrow as pa

from loamgraph.llm.quality import QualityRules, line_statistics, published, running_lines, text_quality

PROSE = "It was a fine morning when the\nharbour-master came down to the\nquay, and nobody spoke. He had been\naway for three years."
GERMAN = "Zwischen Roseton und Pelimouth ist ein\nDampfer mit vier Leuten gesehen worden. Im\nHause wohnen jetzt zehn Familien."
CAPITALS = "SAMSTAG WAR DER LANGE ZUG AUS\nDER STADT NOCH NICHT GEKOMMEN UND\nALLE WARTETEN AUF DEN DAMPFER AUS"
WELSH = "mae hen wlad fy nhadau yn annwyl i mi\ngwlad beirdd a chantorion enwogion o fri\nei gwrol ryfelwyr gwladgarwyr tra mad"
LISTS = [
    "Baker J ........ 12 Mill Row\nCarter K .... 7 Tide Row\nDyer L ..... 9 Oak Row",
    "1. Baker, Hull\n2. Carter, Leeds\n3. Dyer, York",
    "Lot 1 large, table\nItem 2 heavy, chair\nNo. 3 old, clock",
    "• Mary, Hull, 200 tons\n— Anna, York, 80 tons\n* Rose, Bath, 99 tons",
    "Mill | 370 | 770 | 161\nFerry | 400 | 44 | 560",
    "Hull\t10.28\t5.12\t—\nYork\t4.13\t3.02\t—",
    "Hull: Baker; Carter; Dyer\nYork: Smith; Cooper; Wright",
    ");({~*'\na+!`\n| Il•••}o\\.<« ,[ !«",
    "LOCAL NEWS\nBEST TEAS 10s. 4d. PER DOZ.\n£66 REWARD",
]


def test_decisions_and_reasons(spark):
    texts = [PROSE, GERMAN, CAPITALS, WELSH, *LISTS, "", None, " \n\t\n", "word " * 300_000, "\n".join([PROSE, LISTS[0]])]
    df = spark.createDataFrame([(i, t, "wrong") for i, t in enumerate(texts)] + [(None, PROSE, None), (0, PROSE, None)], "doc_id bigint, text string, n_words string")
    words = spark.createDataFrame([("en", "the"), ("en", "The"), ("de", "und"), (None, None), ("en", "")], "lang string, word string")
    rows = text_quality(df, words).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts) + 2
    assert [i for i in range(len(texts)) if got[i]["is_prose"]] == [0, 1, 2, 3, 16, 17]
    assert "few_running_lines" in got[4]["reasons"] and "no_words" in got[13]["reasons"] and "symbols" in got[11]["reasons"] and "bullets" in got[7]["reasons"]
    r = got[0]
    assert (r["n_words"], r["n_lines"], r["punctuated_share"], r["running_share"]) == (23, 4, 0.25, 1.0)
    assert abs(r["common_share"] - 2 / 24) < 0.01 and got[13]["mean_word_length"] == 0
    assert text_quality(df.where("false"), words).count() == 0 and text_quality(df, words.where("false")).count() == len(rows)


CHINESE = "昨天早晨港口主任来到码头看见许多渔船已经回来\n人们站在岸边没有说话因为风浪还没有平静下来\n他离开这里已经三年了"
HINDI = "सुबह बहुत सुंदर थी जब बंदरगाह के मालिक\nघाट पर आए और किसी ने कुछ नहीं कहा\nवह तीन साल से दूर थे और अब लौट आए थे"
ARABIC = "كان صباحا جميلا عندما نزل رئيس الميناء\nإلى الرصيف ولم يتكلم أحد من الناس هناك\nوكان غائبا منذ ثلاث سنوات"
CHINESE_LIST = "一 | 370 | 770 | 161\n二 | 400 | 44 | 560\n1. 王, 北京, 12\n2. 李, 上海, 13"


def test_scripts_without_case(spark):
    df = spark.createDataFrame(list(enumerate([CHINESE, HINDI, ARABIC, CHINESE_LIST])), "doc_id bigint, text string")
    words = spark.createDataFrame([("hi", "और"), ("hi", "थी")], "lang string, word string")
    got = {r["doc_id"]: r for r in text_quality(df, words).collect()}
    assert [got[i]["is_prose"] for i in range(4)] == [True, True, True, False]
    assert got[1]["n_words"] == 28 and got[1]["n_stop_words"] == 2


def test_published_rules_alone(spark):
    long = " ".join(["It was the morning and the harbour was still"] * 8)
    texts = [long, PROSE, "# # " * 40 + long, long.replace("the", "x").replace("and", "y"), "12 34 " * 60 + long, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    words = spark.createDataFrame([("en", "the"), ("en", "and")], "lang string, word string")
    got = {r["doc_id"]: (r["passes"], r["failed"]) for r in published(text_quality(df, words)).collect()}
    assert got[0] == (True, "") and got[1] == (False, "too_short") and got[3] == (False, "few_stop_words")
    assert got[2] == (False, "marks,few_alphabetic") and got[4] == (False, "few_alphabetic") and got[5][1].startswith("too_short")


def test_lines():
    lines = ["away for three years.", "school.", "Item 2 immense, tideboard", "for 45 years, and is now at", "THE HATS TRADE", "23. Heskisley, Kelaby"]
    assert running_lines(line_statistics(pa.array(lines)), QualityRules()).tolist() == [True, True, False, True, False, False]
