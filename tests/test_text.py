import pytest
from pyspark.sql import functions as F

from lamplight.functions import text as T


@pytest.fixture
def value(spark):
    def run(f, *args):
        df = spark.createDataFrame([args], ", ".join(f"a{k} string" for k in range(len(args))))
        return df.select(f(*[F.col(f"a{k}") for k in range(len(args))]).alias("v")).first()[0]

    return run


@pytest.mark.parametrize(("text", "want"), [("1 1/2", 1.5), ("3/4", 0.75), ("11/2", 5.5), ("1,5", 1.0), ("abc", 0.0), (None, 0.0), ("", 0.0), ("12abc", 12.0), ("1/0", None)])
def test_historical_number(value, text, want):
    assert value(T.historical_number, text) == want


@pytest.mark.parametrize(("text", "want"), [("- Свежей Мяты,", "мяты"), ("анис (толчёный) ", "анис"), ("Корицы молотый", "корицы"), (None, ""), ("водки около 1,2 л", "водки")])
def test_clean_name(value, text, want):
    assert value(T.clean_name, text) == want


@pytest.mark.parametrize(("text", "want"), [("щука", "shchuka"), ("соль", "solь"), ("Ёж", "ezh")])
def test_transliterate(value, text, want):
    assert value(T.transliterate, text) == want


@pytest.mark.parametrize(("a", "b", "want"), [("vodka_1", "vodka_22", 0.75), ("", "", 1.0), ("a", "", 0.0)])
def test_positional_similarity(value, a, b, want):
    assert value(T.positional_similarity, a, b) == want


@pytest.mark.parametrize(("text", "want"), [("51,2", 51.2), ("1,2,3", 1.2), (",", None)])
def test_decimal_comma(value, text, want):
    assert value(T.decimal_comma, text) == want


@pytest.mark.parametrize(("text", "want"), [("Квинтэссенция роз", "эссенция"), ("Вода раневая", "настойка"), ("Жизненные капли", "жизненные_капли"), ("Вода мятная", "лечебная_вода"), ("Эликсир", "эликсир")])
def test_category(value, text, want):
    assert value(T.elixir_category, text) == want


@pytest.mark.parametrize(("text", "volume", "strength"), [("получают 12.5 дкл, 45° по Траллесу", 12.5, 45.0), ("1,5 л", 5.0, None), ("без числа", None, None)])
def test_volume_and_strength(value, text, volume, strength):
    assert value(lambda c: T.volume_and_strength(c)[0], text) == volume
    assert value(lambda c: T.volume_and_strength(c)[1], text) == strength


def test_truncate(value):
    assert value(lambda c: T.truncate_at_word(c, 10), "aaa bbb ccc") == "aaa bbb cc..."
    assert value(lambda c: T.truncate_at_word(c, 20), "aaa bbb ccc") == "aaa bbb ccc"


def test_trim_all(value):
    assert value(T.trim_all, " ﻿ x y\n") == "x y"


def test_plain_number(spark):
    r = spark.createDataFrame([(3.0,), (51.2,)], "x double").select(T.plain_number(F.col("x")).alias("v")).collect()
    assert [x[0] for x in r] == ["3", "51.2"]


def test_unit(spark):
    r = spark.createDataFrame([(2.0, "штоф"), (1.0, "пуд"), (1.0, "?")], "a double, u string").select(T.convert_unit(F.col("a"), F.col("u")).alias("v")).collect()
    assert [x[0] for x in r] == [2.46, 16380.0, None]
