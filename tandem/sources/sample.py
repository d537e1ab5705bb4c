"""Bilingual documents made by rule, with planted differences: layout lines in English and French."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions import lexicons as lx

NARROW_SPACE = "\u202f"


def amount(value: Column, code: str) -> Column:
    """A value with two decimals as the language writes it."""
    text = F.format_number(value, 2)
    if code == "en":
        return text
    return F.translate(text, ",.", NARROW_SPACE + "," if code == "fr" else ".,")


def day(ts: Column, code: str) -> Column:
    names: dict[int, str] = {}
    for word, n in lx.MONTHS[code].items():
        names.setdefault(n, word)
    month = F.element_at(F.array(*(F.lit(names[n].title() if code in ("en", "de") else names[n]) for n in range(1, 13))), F.month(ts))
    d, y = F.dayofmonth(ts).cast("string"), F.year(ts).cast("string")
    parts = {"en": [d, " ", month, " ", y], "fr": [d, " ", month, " ", y], "de": [d, ". ", month, " ", y], "es": [d, " de ", month, " de ", y]}[code]
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def bilingual_lines(runs: DataFrame) -> DataFrame:
    """Lines of two documents for each run (run_id, amount, day, other_amount, other_day, extra).

    The French side states ``other_amount`` and ``other_day``, and has a section
    of its own where ``extra`` holds.
    """
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    en = [
        ("Alpine Trading Limited", True), ("This contract is made between the buyer and the seller, who are named in it.", False), ("1. Price", True), (text("The total price of the shares is EUR ", amount(F.col("amount"), "en"), " and it shall be paid in cash."), False),
        ("2. Closing", True), (text("The closing of the sale will be held on ", day(F.col("day"), "en"), " at the office of the seller."), False), ("3. Language", True), ("The English version of this contract shall prevail over all others.", False),
    ]
    fr = [
        ("Alpine Trading SA", True), ("Ce contrat est conclu entre l'acheteur et le vendeur, qui sont nommés dans le texte.", False), ("1. Prix", True), (text("Le prix total des actions est de EUR ", amount(F.col("other_amount"), "fr"), " et il sera payé en espèces."), False),
        ("Annexe sur les frais", "extra"), ("Les frais de la vente sont à la charge de l'acheteur et de lui seul.", "extra"),
        ("2. Clôture", True), (text("La clôture de la vente aura lieu le ", day(F.col("other_day"), "fr"), " dans les bureaux du vendeur."), False), ("3. Langue", True), ("La version anglaise de ce contrat prévaut sur toutes les autres.", False),
    ]
    rows = []
    for slot, lines in (("en", en), ("zh", fr)):
        for n, (t, kind) in enumerate(lines):
            head = kind is True or (kind == "extra" and n % 2 == 0)
            keep = F.col("extra") if kind == "extra" else F.lit(True)
            rows.append(F.struct(F.lit(slot).alias("slot"), F.lit(1).alias("page"), F.lit(n).alias("block_no"), F.lit(0).alias("line_no"), (F.lit(t) if isinstance(t, str) else t).alias("text"), F.lit(10.0).alias("size"), F.lit(head).alias("bold"), F.lit(50.0).alias("x0"), F.lit(60.0 + 30 * n).alias("y0"), F.lit(300.0).alias("x1"), F.lit(70.0 + 30 * n).alias("y1"), keep.alias("keep")))
    return runs.select("run_id", F.explode(F.array(*rows)).alias("l")).select("run_id", "l.*").where("keep").drop("keep")
