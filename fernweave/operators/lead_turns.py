"""Lead collection turn by turn: a fold over one owner's turns in order, with a small state between them.

What a turn says (fields, products named, a choice, a cancellation, interest) is found by DataFrame functions; the fold only
carries the draft on. It starts from what is saved of an owner, asks for a refresh of a profile that has become stale, settles
the product among several, starts anew after a cancellation, and saves a draft as soon as it is complete and valid.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.functions.display import choice
from fernweave.functions.text import national_phone, shows_interest
from fernweave.operators.leads import FIELDS, MONEY, cancels, extracted, missing, prompt, summary
from fernweave.operators.retrieval import alias_matches

# Fixed value: days after which a saved profile has to be asked for again.
STALE_DAYS = 183
# What a reply says.
CANCELLED, ASK_BEFORE, ASK_AFTER = "ยกเลิกการเก็บข้อมูลผู้สนใจแล้ว", "กรุณาแจ้ง ", " เพิ่มเติม"
CHOOSE_BEFORE, CHOOSE_AFTER = "พบผลิตภัณฑ์ชื่อใกล้กัน กรุณาเลือกว่าหมายถึงรายการใด\n\n", "\n\nพิมพ์ชื่อผลิตภัณฑ์หรือหมายเลขรายการ"
INVALID, SAVED_BEFORE, SAVED_AFTER = "ยังบันทึกไม่ได้ กรุณาแก้ข้อมูล: ", "สอบถามเกี่ยวกับ ", " ต่อได้เลย เช่น ความคุ้มครอง ระยะเวลาชำระเบี้ย หรือผลประโยชน์ตามกรมธรรม์"

_TYPES = {"income": "decimal(14,2)", "income_min": "decimal(14,2)", "income_max": "decimal(14,2)"}
RESULT = ", ".join(["owner_id {owner}", "turn {turn}", *(f"{f} {_TYPES.get(f, 'string')}" for f in FIELDS), "status string", "outcome string", "refreshed boolean", "candidates array<string>"])
_PLAIN = ("name", "occupation", "phone")


@dataclass
class Draft:
    """What is carried from one turn of an owner to the next."""

    fields: dict[str, Any] = field(default_factory=lambda: dict.fromkeys(FIELDS))
    status: str = "unconfirmed"
    phone_fits: bool = True
    candidates: list[str] = field(default_factory=list)
    verified: datetime.datetime | None = None
    saved_product: str | None = None
    refresh_asked: bool = False

    def clear(self, product: str | None = None) -> None:
        self.fields = dict.fromkeys(FIELDS) | {"product_id": product}
        self.status, self.phone_fits = "unconfirmed", True

    def complete(self) -> bool:
        known = self.fields
        return bool(known["name"] and known["occupation"] and known["phone"] and known["product_id"]) and known["income"] is not None and known["income_currency"] == "THB" and known["income_period"] == "monthly_thb"


def _settle_product(draft: Draft, said: dict[str, Any]) -> str | None:
    """The product that a turn gives; the draft's candidates become those that are still to be chosen from."""
    number, named = int(said["number"] or 0), said["products"]
    if 1 <= number <= len(draft.candidates):
        product = draft.candidates[number - 1]
        draft.candidates = []
        return product
    if named:
        draft.candidates = named if len(named) > 1 else []
        return named[0] if len(named) == 1 else None
    return None if draft.candidates else said["active_product_id"]


def advance(draft: Draft, said: dict[str, Any]) -> tuple[str, bool]:
    """Take one turn into a draft: what came of it (cancelled, saved, invalid, choose, asks), and whether a refresh began."""
    stale = draft.verified is not None and said["at"] is not None and said["at"] - draft.verified >= datetime.timedelta(days=STALE_DAYS)
    refreshed = stale and not draft.refresh_asked
    if refreshed:
        draft.clear(draft.saved_product)
        draft.refresh_asked = True
    elif draft.status == "cancelled" and said["interested"]:
        draft.clear()
    product = _settle_product(draft, said)
    came = {f: said[f] for f in _PLAIN if said[f] is not None} | ({f: said[f] for f in MONEY} if said["income_said"] else {})
    draft.fields |= came
    if product is not None:
        draft.fields["product_id"] = product
    if "phone" in came:
        draft.phone_fits = said["phone_fits"]
    if draft.candidates:
        draft.fields["product_id"], draft.status = None, "unconfirmed"
    if said["cancels"]:
        draft.status, draft.candidates = "cancelled", []
        return "cancelled", refreshed
    if not draft.complete():
        return ("choose" if draft.candidates else "asks"), refreshed
    known = draft.fields["product_id"] in said["catalogue"] if said["catalogue"] is not None else True
    if not (draft.phone_fits and known):
        return "invalid", refreshed
    draft.status, draft.verified, draft.saved_product, draft.refresh_asked = "confirmed", said["at"], draft.fields["product_id"], False
    return "saved", refreshed


def _started(row: dict[str, Any]) -> Draft:
    """The draft of an owner before the first turn: what is saved of them, if anything."""
    draft, lead = Draft(), row["lead"]
    if lead is not None:
        draft.fields, draft.status = {f: lead[f] for f in FIELDS}, "confirmed"
        draft.verified, draft.saved_product, draft.refresh_asked = lead["verified_at"], lead["product_id"], bool(lead["refresh_asked"])
    return draft


def lead_turns(turns: DataFrame, aliases: DataFrame, leads: DataFrame) -> DataFrame:
    """The draft after each turn: (owner_id, turn, the fields, status, outcome, refreshed, candidates, missing).

    turns: (owner_id, turn, at, text, active_product_id), each turn once; aliases: (product_id, alias) of the catalogue, which
    has the products that can be saved; leads: (owner_id, the fields, verified_at, refresh_asked), an owner at most once.
    Null texts say nothing, null owners are one owner, a turn without a time makes no profile stale. Each owner's turns go through a
    task in order with one small state, so an owner may have any number of them.
    """
    key = F.struct("owner_id", "turn")
    asked = turns.select(key.alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))
    named = alias_matches(asked, aliases).groupBy("query_id").agg(F.array_sort(F.collect_set("product_id")).alias("products"))
    named = named.select(F.col("query_id.owner_id").alias("owner_"), F.col("query_id.turn").alias("turn_"), "products")
    own = extracted(turns.select("owner_id", "turn", F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("product_id"))).drop("product_id")
    text = F.col("text")
    own = own.withColumns({"cancels": cancels(text), "interested": F.coalesce(shows_interest(text), F.lit(False)), "number": choice(text), "phone_fits": national_phone(F.col("phone")).isNotNull()}).drop("text")
    times = turns.select(F.col("owner_id").alias("owner_t"), F.col("turn").alias("turn_t"), F.col("at").cast("timestamp").alias("at"), "active_product_id")
    saved = leads.select(F.col("owner_id").alias("owner_l"), F.struct(*FIELDS, F.col("verified_at").cast("timestamp").alias("verified_at"), "refresh_asked").alias("lead"))
    same = lambda o, t: F.col("owner_id").eqNullSafe(F.col(o)) & (F.col("turn") == F.col(t))
    rows = own.join(times, same("owner_t", "turn_t")).join(named, same("owner_", "turn_"), "left").join(saved, F.col("owner_id").eqNullSafe(F.col("owner_l")), "left").drop("owner_t", "turn_t", "owner_", "turn_", "owner_l")
    catalogue = {r[0] for r in aliases.select("product_id").distinct().collect()}  # the same short list that is looked for in texts

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        draft, owner, begun = Draft(), None, False
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                row = {k: None if _is_null(v) else v for k, v in row.items()}
                if not begun or row["owner_id"] != owner:
                    draft, owner, begun = _started(row), row["owner_id"], True
                said = row | {"products": list(row["products"]) if row["products"] is not None else [], "catalogue": catalogue}
                outcome, refreshed = advance(draft, said)
                out.append((row["owner_id"], row["turn"], *(draft.fields[f] for f in FIELDS), draft.status, outcome, refreshed, list(draft.candidates)))
            yield pd.DataFrame(out, columns=columns)

    schema = RESULT.format(owner=turns.schema["owner_id"].dataType.simpleString(), turn=turns.schema["turn"].dataType.simpleString())
    columns = ["owner_id", "turn", *FIELDS, "status", "outcome", "refreshed", "candidates"]
    folded = rows.repartition("owner_id").sortWithinPartitions("owner_id", "turn").mapInPandas(follow, schema)
    return folded.withColumn("missing", F.when(F.col("status") == "cancelled", F.array().cast("array<string>")).otherwise(missing()))


def _is_null(value: Any) -> bool:
    return value is None or value is pd.NaT or (isinstance(value, float) and value != value)


def replies(folded: DataFrame, labels: DataFrame) -> DataFrame:
    """(owner_id, turn, reply, summary) for what ``lead_turns`` gives; labels: (product_id, label), each product once."""
    names = F.broadcast(labels.agg(F.map_from_entries(F.collect_list(F.struct("product_id", "label"))).alias("names")))  # one row: the catalogue's labels
    own = folded.crossJoin(names)

    def label(product):
        return F.coalesce(F.try_element_at("names", product), product)

    lines = F.array_join(F.transform("candidates", lambda p, k: F.concat((k + 1).cast("string"), F.lit(". **"), label(p), F.lit("**"))), "\n")
    asks = F.concat(F.lit(ASK_BEFORE), prompt(F.col("missing")), F.lit(ASK_AFTER))
    reply = (
        F.when(F.col("outcome") == "cancelled", F.lit(CANCELLED)).when(F.col("outcome") == "choose", F.concat(F.lit(CHOOSE_BEFORE), lines, F.lit(CHOOSE_AFTER)))
        .when(F.col("outcome") == "saved", F.concat(F.lit(SAVED_BEFORE), label(F.col("product_id")), F.lit(SAVED_AFTER)))
        .when(F.col("outcome") == "invalid", F.concat(F.lit(INVALID), F.when(national_phone(F.col("phone")).isNull(), F.lit("phone must be a Thai 9-10 digit national number after normalization")).otherwise(F.lit("product_id is not present in the active product catalog")))).otherwise(asks)
    )
    return own.select("owner_id", "turn", reply.alias("reply"), summary().alias("summary"))
