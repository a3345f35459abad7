from pyspark.sql import functions as F

from lamplight.operators import chunks, ingredients, records, statistics, store

R1 = "**12. Водка анисовая.**\nВозьмите: анис — 12 золотников (около 51,2 г), корица — 1 1/2 золотника (около 6,4 г).\n3 штофа (около 3,69 л) водки.\nИстолочь и настаивать две недели, потом перегнать.\n"
BODY = "настаивать на мяте две недели, потом перегнать через медный куб и разлить"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_record_with_ingredients(spark):
    row = ingredients.with_ingredients(records.main_records(docs(spark, R1))).first()
    assert (row.number, row.name) == (12, "Водка анисовая")
    got = [(i.name, i.amount, i.unit, i.modern_amount, i.modern_unit) for i in row.ingredients]
    assert got[:3] == [("анис", 12.0, "золотник", 51.2, "г"), ("корица", 1.5, "золотник", 6.4, "г"), ("водки", 3.0, "штоф", 3.69, "л")]
    assert got[3][:3] == ("водка", 3.0, "штоф") and abs(got[3][3] - 3.69) < 1e-9
    per = row.ingredients_per_liter[0]
    assert abs(per.base_volume - 7.38) < 1e-9 and abs(per.amount_per_liter - 51.2 / 7.38) < 1e-9
    assert row.description == "и настаивать две недели, потом перегнать."
    assert row.historical_measures[0].modern_equivalent == "51.2 г"


def test_listed_ingredients(spark):
    t = "мяты, аниса, тмина — по 2 золотника (около 8,5 г)"
    r = docs(spark, t).select(ingredients.measured(F.col("text")).alias("i")).first().i
    listed = [(x.name, x.amount, x.modern_amount) for x in r if x.modern_amount == 8.5]
    assert ("мяты", 2.0, 8.5) in listed and ("аниса", 2.0, 8.5) in listed and ("тмина", 2.0, 8.5) in listed


def test_line_scanner(spark):
    t = f"1. Мятная водка\n{BODY}\n0. Пустая\n{BODY}\n2. Ликёр розовый\n{BODY}\n1. Повтор\n{BODY}"
    rows = records.vodka_book(docs(spark, t)).collect()
    assert [(r.number, r.name, r.source_pattern) for r in rows] == [(1, "Мятная водка", "plain_number_title")]


def test_overlapping_families(spark):
    t = "**7. Ликёр вишнёвый.**\nВозьмите: " + "вишни спелые без косточек, сахару и воды, и дать постоять на солнце"
    rows = records.vodka_book(docs(spark, t)).collect()
    assert [(r.number, r.name, r.category, r.original_number) for r in rows] == [(7, "Ликёр вишнёвый", "водка", None), (210, "Ликёр вишнёвый", "ликёр", 7)]
    assert rows[1].id == "recipe_210" and rows[1].full_text.startswith("Ликёр вишнёвый\n\nВозьмите:")


def test_liqueurs_number_on_from_last_vodka(spark):
    t = f"**250. Водка мятная.**\n{BODY}\n**3) Розовый.**\nСостав: {BODY}\n"
    assert [(r.number, r.source_pattern) for r in records.vodka_book(docs(spark, t)).collect()] == [(250, "starred_number_title"), (251, "paragraph_liqueur")]


def test_headings_and_cap(spark):
    t = "".join(f"**{k}. Водка {k} мятная.**\n{BODY * 2}\n" for k in range(1, 6)) + f"**9. Водки тминные.**\n{BODY * 2}\n"
    assert [r.number for r in records.starred_records(docs(spark, t)).orderBy("pos").collect()] == [1, 2, 3, 4, 5]
    assert records.starred_records(docs(spark, t), most=3).count() == 3


def test_elixirs_perfumes_oils_french(spark):
    numbered = f"§ 5. \n1. Эликсир жизни.\n\nВозьми корень. {BODY}\n"
    simple = f"§ 6. \nТинктура мятная.\n\nВозьми мяту. {BODY}\n"
    rows = records.elixir_records(docs(spark, numbered + simple)).orderBy("original_paragraph").collect()
    assert [(r.original_paragraph, r.category, r.source_pattern) for r in rows] == [(5, "эликсир", "elixir_numbered"), (6, "тинктура", "elixir_simple")]
    perfume = f"§ 1. \n2. Лавандовая.\nEau de lavande.\n\nВозьми цветы. {BODY} {BODY}\n"
    p = records.perfume_records(docs(spark, perfume)).first()
    assert (p.name, p.french_name, p.original_recipe_number) == ("Вода Лавандовая", "Eau de lavande", 2)
    assert p.full_text.startswith("Вода Лавандовая\nEau de lavande\n\nВозьми")
    oil = records.oil_records(docs(spark, f"§ 3. \nМасло розовое.\n\nВозьми розы. {BODY} {BODY}\n")).first()
    assert (oil.name, oil.category) == ("Масло розовое", "ароматическое_масло")
    french = f"§ 2. Введение {'слово ' * 40}\n4. Вода мятная.\nВозьми мяту и {BODY} {BODY}\nвторая строка\n"
    f = records.french_records(docs(spark, french)).collect()
    assert len(f) == 1 and f[0].name == "Ликёр мятная" and "вторая" not in f[0].content


def test_family_numbers_run_on(spark):
    filler = "\n" + "x" * 60
    a = f"**12. Водка мятная.**\n{BODY}{filler}\n"
    b = f"Эликсир\n§ 5. \n1. Эликсир жизни.\n\nВозьми корень. {BODY}\n§ 6. \nТинктура мятная.\n\nВозьми мяту. {BODY}\n"
    rows = records.family_book(docs(spark, a, b), shortest=10).collect()
    assert [(r.doc_id, r.number) for r in rows] == [(0, 12), (1, 13), (1, 14)]


def test_merge_of_units(spark):
    rows = [("мята", 5.0, "г"), ("мята", 3.0, "г"), ("мята", 1.0, "л")]
    df = spark.createDataFrame([([(n, 1.0, "u", a, u) for n, a, u in rows],)], f"i {ingredients.SCHEMA}")
    got = df.select(ingredients.merged(F.col("i")).alias("m")).first().m
    assert [(x.name, x.modern_amount, x.modern_unit) for x in got] == [("мята", 8.0, "г")]


def test_cleaning(spark):
    texts = ["a  b", "а\nб", "а\n\nб", "А\nБ"]
    got = {r.doc_id: r.c for r in docs(spark, *texts).select("doc_id", chunks.clean_scan(F.col("text")).alias("c")).collect()}
    assert [got[k] for k in range(4)] == ["a b", "а б", "аб", "А\nБ"]
    kept = docs(spark, "а \n\n\n б").select(chunks.clean_scan(F.col("text"), keep_paragraphs=True).alias("c")).first().c
    assert kept == "а\n\nб"


def test_chunks(spark):
    rows = chunks.described(chunks.chunked(docs(spark, "a b c d e"), 2)).orderBy("chunk_index").collect()
    assert [(r.text, r.chunk_index, r.total_chunks, r.estimated_tokens) for r in rows] == [("a b", 1, 3, 3), ("c d", 2, 3, 3), ("e", 3, 3, 2)]


def stored(spark):
    item = lambda n, u="штоф": (n, 1.0, u, 2.0, "г")
    return spark.createDataFrame([(1, "A", 1, [item("анис"), item("мята")]), (2, "B", 2, [item("анис")]), (3, "C", 3, [item("тмин")])], f"id long, name string, recipe_number int, ingredients {ingredients.SCHEMA}")


def test_statistics_and_search(spark):
    assert [(r.ingredient_name, r.usage_count) for r in statistics.ingredient_stats(stored(spark)).collect()] == [("анис", 2)]
    hits = statistics.search_by_element(stored(spark), "штоф").collect()
    assert [(r.id, r.matching_ingredients) for r in hits] == [(1, []), (2, []), (3, [])]
    assert [r.matching_ingredients for r in statistics.search_by_element(stored(spark), "МЯТ").collect()] == [["мята"]]
    assert statistics.search_by_element(stored(spark), "%", literal=True).count() == 0
    assert [r.id for r in statistics.top_by_items(stored(spark), 2).collect()] == [1, 2]


def test_sql_functions(spark):
    from lamplight.functions.sql_functions import register

    stored(spark).createOrReplaceTempView("drinks_recipes")
    register(spark)
    assert spark.sql("SELECT id, matching_ingredients FROM search_recipes_by_ingredient('мят')").collect()[0].matching_ingredients == ["мята"]
    r = spark.sql("SELECT * FROM get_ingredient_statistics()").collect()
    assert [(x.ingredient_name, x.usage_count) for x in r] == [("анис", 2)]


def test_write_and_upsert(spark, tmp_path):
    rows = store.table_rows(ingredients.with_ingredients(records.main_records(docs(spark, R1))))
    bad = rows.withColumn("name", F.lit(None).cast("string"))
    assert store.write_table(rows.unionByName(bad), str(tmp_path / "t")) == {"success": 1, "error": 1}
    assert spark.read.parquet(str(tmp_path / "t" / "rows")).count() == 1
    again = store.upsert(rows, rows, ["id"], [F.col("updated_at")])
    assert again.count() == 1
    assert store.upsert(None, rows.unionByName(rows), ["id"], [F.col("updated_at")]).count() == 1


def test_quarantine(spark):
    good, bad = store.quarantined(docs(spark, None, "", "x", "y" * 200), store.document_checks())
    assert [r.doc_id for r in good.collect()] == [3]
    assert {r.doc_id: r.error for r in bad.collect()} == {0: "no content", 1: "no content", 2: "too short"}


def test_running_start_over_blocks(spark):
    import random

    rng = random.Random(2)
    rows = [(k, rng.choice([None, rng.randint(1, 300)]), rng.randint(0, 9)) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, top int, others long")
    want, now = {}, 1
    for k, top, others in rows:
        now = max(now, (top or 0) + 1)
        want[k] = now
        now += others
    for blocks in (1000, 7):
        assert {r.doc_id: r.next for r in records.running_start(df, blocks).collect()} == want


def test_texts_that_begin_alike_stay(spark, tmp_path):
    from pyspark.sql import functions as F

    from lamplight.plans.registry import QUERIES

    same = "a shared masthead of more than forty characters: "
    rows = [(1, same + "one", "b"), (2, same + "two", "b"), (3, same + "three", "b"), (13, same + "four", "b"), (5, same + "two", "c"), (6, same + "one", "a"), (7, same + "TWO", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.pos: r.digest for r in QUERIES["first_wins_texts"](spark, str(tmp_path)).collect()}
    want = {r.doc_id: r.m for r in df.select("doc_id", F.md5("text").alias("m")).collect() if r.doc_id in (2, 3, 7, 13)}
    assert got == want


def test_many_sections_of_a_text(spark):
    """A text of more sections than a product of numbers would hold keeps the order of its records."""
    piece = lambda k: f"§ {k}. Введение {'слово ' * 40}\n{k}. Вода мятная.\nВозьми мяту и {BODY} {BODY}\n"
    text = "".join(piece(k) if k in (1, 21_600) else f"§ {k}. x\n" for k in range(1, 21_601))
    got = records.french_records(docs(spark, text)).orderBy("pos").collect()
    assert [(r.pos, r.original_recipe_number) for r in got] == [(0, 1), (1, 21_600)]
