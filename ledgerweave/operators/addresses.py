"""Free-text wallet lists: split, check, keep the first of each valid address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions.scalars import address_ok
from ledgerweave.functions.stage import stage


def address_tokens(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Tokens of each text with their verdict; a valid address appears once, at its first place.

    Repeats are found inside the row that holds the text, so nothing is shuffled.
    """
    tokens = F.filter(F.split(F.trim(text), r"[\s,;]+"), lambda t: t != "")
    judged = F.transform(tokens, lambda t: F.struct(t.alias("token"), address_ok(t).alias("valid")))
    listed = stage(rows.select(key, F.col(text)), {"_t": judged}, keep=[key])
    firsts = F.filter(
        F.transform("_t", lambda t, i: F.struct(i.alias("i"), t["token"].alias("token"), t["valid"].alias("valid"))),
        lambda t: ~t["valid"] | (F.array_position(F.transform("_t", lambda u: u["token"]), t["token"]) == t["i"] + 1),
    )
    return listed.select(key, F.posexplode(firsts).alias("_p", "_f")).select(
        key, F.col("_p").alias("pos"), "_f.token", "_f.valid"
    )
