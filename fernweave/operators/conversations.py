"""Reads over messages, sessions and events: inboxes, histories, contexts and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def inbox(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every session with its messages: count, last turn, and a title from the first thing its user said."""
    first = F.min(F.when(F.col("role") == "user", F.struct("turn", "text")))["text"]
    told = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.max("turn").alias("last_turn"), first.alias("first_text"))
    joined = sessions.join(told, "conv_id", "left")
    return joined.select("conv_id", "status", F.coalesce("messages", F.lit(0)).alias("messages"), "last_turn", F.coalesce(F.substring("first_text", 1, 72), F.lit("New conversation")).alias("title"))


def last_messages(messages: DataFrame, most: int, purpose: str | None = None) -> DataFrame:
    """The last messages of each conversation, numbered from the oldest of them; with a purpose, of those that have it."""
    if purpose is not None:
        messages = messages.where(F.col("purpose") == purpose)
    back = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    kept = messages.withColumn("back", back).where(F.col("back") <= most)
    return kept.withColumn("place", F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))).drop("back")


def bounded_context(messages: DataFrame, most: int = 6, each: int = 400, total: int = 2400) -> DataFrame:
    """(conv_id, context): the last messages, each cut, newest first until the total is full, joined oldest first."""
    cut = messages.withColumn("cut", F.substring("text", 1, each))
    newest = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    sized = cut.withColumns({"back": F.row_number().over(newest), "used": F.sum(F.length("cut")).over(newest.rowsBetween(W.unboundedPreceding, 0))}).where((F.col("back") <= most) & (F.col("used") <= total))
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "cut").alias("line"))))
    return sized.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("context"))


def with_any(sessions: DataFrame, messages: DataFrame, role: str) -> DataFrame:
    """Sessions with a message of the role."""
    return sessions.join(messages.where(F.col("role") == role), "conv_id", "left_semi")


def queue(cases: DataFrame, staff: str) -> DataFrame:
    """Open cases that a member of staff may see: pending ones, and active ones that are theirs; pending first."""
    seen = (F.col("status") == "pending") | ((F.col("status") == "active") & (F.col("staff") == staff))
    return cases.where(seen).orderBy(F.when(F.col("status") == "pending", 0).otherwise(1), F.desc("opened"), "case_id")


def live_logins(logins: DataFrame, now: Column) -> DataFrame:
    """Logins that are neither revoked nor expired."""
    return logins.where(F.col("revoked_at").isNull() & (F.col("expires_at") > now))


def restored_logins(logins: DataFrame, accounts: DataFrame, now: Column) -> DataFrame:
    """(token_hash, owner_id, username, account_role): the account that each live login restores; others restore none."""
    return live_logins(logins, now).join(accounts, "owner_id").select("token_hash", "owner_id", "username", "account_role")


def leads_of_sessions(sessions: DataFrame, leads: DataFrame, now: Column) -> DataFrame:
    """The saved lead of each session's owner, as staff see it, and whether it is stale; sessions without one are left out.

    leads: an owner at most once, with profile_verified_at, updated_at and created_at.
    """
    stale = is_stale(F.col("profile_verified_at"), F.col("updated_at"), F.col("created_at"), now)
    return sessions.select("session_id", "owner_id").join(leads.withColumn("is_stale", stale), "owner_id")


def elapsed(events: DataFrame, key: str, time: str, order: str) -> DataFrame:
    """elapsed_us: microseconds since the event before of the same key; null for the first."""
    before = F.lag(F.col(time)).over(W.partitionBy(key).orderBy(time, order))
    return events.withColumn("elapsed_us", F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(before.cast("timestamp")))


def is_stale(verified: Column, updated: Column, created: Column, now: Column, days: int = 183) -> Column:
    """Whether the last known time is at least so many days ago; a time that cannot be read is stale."""
    last = F.coalesce(*[F.try_to_timestamp(c.cast("string")) for c in (verified, updated, created)])
    return F.coalesce(last <= now - F.make_interval(days=F.lit(days)), F.lit(True))


def staff_inbox(accounts: DataFrame, sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Every customer with their active session, if any, its messages and when the last one came; the latest first.

    accounts: (owner_id, username, account_role); sessions: (session_id, owner_id, status, last_active_at); messages:
    (session_id, created_at). The status is a condition of the join, so that customers without a session stay.
    """
    own = accounts.where("account_role = 'customer'").select("owner_id", "username")
    active = sessions.where("status = 'active'").select("owner_id", "session_id", "last_active_at")
    told = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("message_count"), F.max("created_at").alias("last_message_at"))
    joined = own.join(active, "owner_id", "left").join(told, "session_id", "left")
    rows = joined.select("owner_id", "username", "session_id", "last_active_at", F.coalesce("message_count", F.lit(0)).alias("message_count"), "last_message_at")
    return rows.orderBy(F.coalesce("last_message_at", "last_active_at").desc_nulls_last(), "username")


def open_handoffs(cases: DataFrame, accounts: DataFrame) -> DataFrame:
    """The newest case of each session that is pending or active, with the name of the staff it is assigned to."""
    newest = cases.where(F.col("status").isin("pending", "active")).groupBy("session_id").agg(F.max_by(F.struct(*cases.columns), "case_id").alias("c")).select("c.*")
    return newest.join(accounts.select(F.col("owner_id").alias("assigned_staff_id"), F.col("username").alias("assigned_staff_name")), "assigned_staff_id", "left")


def staff_queue(cases: DataFrame, sessions: DataFrame, accounts: DataFrame, messages: DataFrame, staff: Column) -> DataFrame:
    """Open cases of active sessions of customers that a member of staff may see, with messages counted; pending first."""
    seen = cases.where((F.col("status") == "pending") | ((F.col("status") == "active") & (F.col("assigned_staff_id") == staff)))
    customers = accounts.where("account_role = 'customer'").select("owner_id", F.col("username").alias("customer_name"))
    names = accounts.select(F.col("owner_id").alias("assigned_staff_id"), F.col("username").alias("assigned_staff_name"))
    told = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("message_count"), F.max("created_at").alias("last_message_at"))
    joined = seen.join(sessions.where("status = 'active'").select("session_id", "owner_id"), "session_id").join(customers, "owner_id").join(names, "assigned_staff_id", "left").join(told, "session_id", "left")
    rows = joined.select("case_id", "session_id", "status", "created_at", "assigned_staff_id", F.col("owner_id").alias("customer_id"), "customer_name", "assigned_staff_name", F.coalesce("message_count", F.lit(0)).alias("message_count"), "last_message_at")
    return rows.orderBy(F.when(F.col("status") == "pending", 0).otherwise(1), F.coalesce("last_message_at", "created_at").desc(), "case_id")


def product_history(messages: DataFrame, sessions: DataFrame, lead_like: Column, masked: Column, known: Column, most: int = 8, cut: int = 300) -> DataFrame:
    """(owner_id, turn, text): of each owner's last user messages in active sessions those about products, masked and cut.

    messages: (session_id, turn, role, text, purpose). lead_like, masked and known are columns over the text: whether it
    is of a lead, the text without contact data, whether it names a known product.
    """
    own = messages.where("role = 'user'").join(sessions.where("status = 'active'").select("session_id", "owner_id"), "session_id")
    last = own.withColumn("back", F.row_number().over(W.partitionBy("owner_id").orderBy(F.desc("session_id"), F.desc("turn")))).where(F.col("back") <= most)
    return last.where(~lead_like & ((F.col("purpose") == "product") | known)).select("owner_id", "session_id", "turn", F.substring(masked, 1, cut).alias("text"))


def closed_vocabulary(texts: DataFrame, products: list[str], topics: list[str]) -> DataFrame:
    """Which listed products and topics each text names, in the order of the lists; nothing else of it is handed on."""

    def named(terms: list[str]) -> Column:
        return F.filter(F.array(*[F.when(F.contains(F.lower("text"), F.lit(t.lower())), t) for t in terms]), lambda x: x.isNotNull())

    return texts.select(*[c for c in texts.columns if c != "text"], named(products).alias("products"), named(topics).alias("topics"))


def with_sessions(accounts: DataFrame, sessions: DataFrame, now: Column) -> DataFrame:
    """sessions with a new active one for each customer without any; staff get none."""
    lacking = accounts.where("account_role = 'customer'").join(sessions.where("status = 'active'").select("owner_id").distinct(), "owner_id", "left_anti")
    return sessions.unionByName(lacking.select(F.concat(F.lit("s-"), F.col("owner_id").cast("string")).alias("session_id"), "owner_id", F.lit("active").alias("status"), now.alias("last_active_at")))


def annotated(messages: DataFrame, turns: DataFrame) -> DataFrame:
    """messages (request_id, purpose, metadata) with purpose and citations of turns (request_id, purpose, citations).

    A turn's answer has the request id with ``:assistant`` behind it. Messages of other requests stay as they are.
    """
    told = turns.select(F.explode(F.array(F.col("request_id"), F.concat("request_id", F.lit(":assistant")))).alias("request_id"), F.col("purpose").alias("new_purpose"), F.to_json(F.struct("citations")).alias("new_metadata"))
    joined = messages.join(told, "request_id", "left")
    return joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in ("purpose", "metadata") else F.col(c) for c in messages.columns])


def refresh_requested(profiles: DataFrame, owners: DataFrame, now: Column) -> DataFrame:
    """profiles with refresh_requested_at set for the owners who have none yet."""
    joined = profiles.join(owners.select("owner_id").distinct().withColumn("asked_", F.lit(True)), "owner_id", "left")
    return joined.withColumn("refresh_requested_at", F.when(F.col("asked_"), F.coalesce("refresh_requested_at", now)).otherwise(F.col("refresh_requested_at"))).drop("asked_")


def authorised(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Requests (session_id, access_token) for active sessions whose token has the stored hash."""
    held = sessions.where("status = 'active'").select("session_id", "token_hash")
    return requests.withColumn("token_hash", F.sha2("access_token", 256)).join(held, ["session_id", "token_hash"], "left_semi").drop("token_hash")
