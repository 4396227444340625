"""Rows that every operator has to take: nulls, empty and long texts, repeated rows, odd characters."""

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id string, n int, set_key string, "
          "sketch string, grp int, block string, uid string, island int, length string, score string, key string")
_REST = ("en", "s", 1, "x", 7, "k", "s", 3, "b", "u", 2, "l", "sc", "key")
LONG = " ".join(f"word{i % 977} und{i % 13}" for i in range(60_000))
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Only four words here"), (6, "Éa ßü ñ a line.\nAnd another line here, with more words!"),
    (6, "Éa ßü ñ a line.\nAnd another line here, with more words!"), (7, LONG), (8, "12 34 $$ %%"), (None, "a row without an id but with words in it"),
    (9, None), (10, "<|im_end|> \\ <\\| ' \" \x00\x1c\x85 \U0001f600 中文字"), (11, "The MIT License and the general public license."),
]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, *_REST) for i, t in texts], SCHEMA)
