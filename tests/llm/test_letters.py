"""Languages of scripts other than Latin, told apart by letters of their own."""

import random

import numpy as np

from corvello.llm import language_id

WORDS = {
    "el": "και το να του η που με για από δεν θα είναι στο τα σε ένα αυτό μας ήταν όμως πολύ καλά σήμερα άνθρωπος θάλασσα",
    "ru": "и в не на что он как это по но они мы все было сказал который человек время очень сегодня хорошо ещё уже если",
    "uk": "і в не на що він як це по але вони ми все було сказав який людина час дуже сьогодні добре ще вже якщо її",
    "ar": "في من على إلى هذا التي كان عن أن مع كل بعد قال يوم رجل جدا اليوم ماء كتاب مدينة",
    "fa": "در از که این را با است برای آن یک خود تا بر هم گفت روز مرد خیلی امروز آب کتاب شهر می‌شود چه",
    "ja": "これは 本です 今日は とても いい 天気 ですね 私は 学校へ 行きます ありがとう 日本語 東京 時間",
    "zh": "这是 一本书 今天 天气 很好 我 去 学校 谢谢 中文 北京 时间 我们 没有 什么 可以 他们 知道",
    "pl": "się nie jest że już też który będzie człowiek został może więc łódź świat życie źle gdzie ćwiczyć",
    "en": "the and of to in is that it was for with as his they this have from not which people time today",
}


def test_other_scripts_are_told_apart(spark, monkeypatch):
    rng = random.Random(5)
    text = lambda lang: " ".join(rng.choices(WORDS[lang].split(), k=5))
    train = [(i, text(lang), lang) for lang in WORDS for i in range(30)]
    langs, profiles = language_id.prototypes(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    monkeypatch.setattr(language_id, "_LANGUAGES", 2)
    again = language_id.prototypes(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert again[0] == langs and np.allclose(again[1], profiles)
    asked = [(i, text(lang), lang) for lang in WORDS for i in range(30)]
    got = language_id.identify(spark.createDataFrame(asked, "doc_id long, text string, lang string"), langs, profiles).collect()
    wrong = [(r.lang, r.lang_pred, r.text) for r in got if r.lang != r.lang_pred]
    assert langs == sorted(WORDS) and len(wrong) <= 0.02 * len(got), (len(wrong), len(got), wrong[:5])


def test_letters_that_shared_a_vector_differ():
    a, b = chr(0x3B1), chr(0x3B1 + 5)  # five code points apart: one class before
    assert set(language_id.trigrams(a * 9)).isdisjoint(language_id.trigrams(b * 9))
    grams = np.unique(language_id.trigrams("aα日 \U00020000b"))
    vectors = language_id.trigram_vectors(grams)
    assert np.abs(vectors @ vectors.T - language_id.DIMENSIONS * np.eye(len(grams))).max() < 200
    cached = language_id._Vectors(most=4)
    assert (cached(grams[:3]) == vectors[:3]).all() and (cached(grams) == vectors).all() and (cached(grams[1:3]) == vectors[1:3]).all()
