"""Quality rules on clean texts in other scripts."""

import random

from opsloom.llm import quality_rules

SCRIPTS = {"cyrillic": ("абвгдежзиклмнопрст", "."), "greek": ("αβγδεζηθικλμνξοπρ", "."), "arabic": ("ابتثجحخدذرزسشصض", "؟"), "hindi": ("कखगघचछजझटठडढणत", "।"), "chinese": ("的一是不了人我在有他这中大来上", "。")}


def test_clean_texts_of_other_scripts_stay(spark):
    random.seed(3)
    rows = []
    for letters, stop in [*SCRIPTS.values(), *[("abcdefghijklmnop", ".")] * 5]:
        for _ in range(10):
            word = lambda: "".join(random.choice(letters) for _ in range(random.randint(15, 40) if stop == "。" else random.randint(3, 8)))
            rows.append((len(rows), " ".join(word() + (stop if i % 12 == 11 else "") for i in range(120))))
    rows += [(1000 + i, "BUY NOW *** $$$ ### " * 20 + str(i)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.apply(docs).collect()}
    assert all(kept[i] for i in range(100)) and not any(kept[1000 + i] for i in range(20))
