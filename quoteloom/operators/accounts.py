"""Users: directory, registration, edits, deletion and the latest login, in batches judged against the table before."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normalize_email, trimmed
from ..functions.validation import INVALID_INPUT, validate_users
from ..schemas import USERS
from .prices import among, dedupe_batch, new_id, replayed

EXISTS = "An account already exists for this email."
OWNED = "Another account already uses this email."
NOT_FOUND = "User not found."
SELF = "You cannot delete the currently signed-in admin account."


def filter_role(users: DataFrame, *roles: str) -> DataFrame:
    return users.where(F.col("role").isin(*roles))


def user_directory(users: DataFrame) -> DataFrame:
    return users.select("_id", "name", "email", "role", "createdAt", "lastLoginAt", "updatedAt")


def user_public(users: DataFrame) -> DataFrame:
    return users.select("_id", "name", "email", "role", "createdAt")


def list_users(users: DataFrame) -> DataFrame:
    return user_directory(users).orderBy(F.desc("createdAt"), F.desc("_id"))


def judge_registrations(users: DataFrame, registrations: DataFrame) -> DataFrame:
    """Registrations (seq, name, email, role, kind) with their normal form, status and message.

    The first valid request of an e-mail wins if no user has it; seeding an existing one is skipped without a word."""
    role = F.when(F.col("kind") == "self", "user").when(F.col("kind") == "seed", "admin").otherwise(F.col("role"))
    asked = validate_users(registrations.withColumns({"name": trimmed(F.col("name")), "email": normalize_email(F.col("email")), "role": role}))
    valid = F.size("errors") == 0
    asked = asked.withColumn("valid", valid)
    first = F.min(F.when(valid, F.col("seq"))).over(among("valid", "seq", "email"))
    known = users.select("email", F.lit(True).alias("known"))
    judged = asked.withColumn("wins", F.coalesce(valid & (F.col("seq") == first), F.lit(False))).join(known, "email", "left")
    status = F.when(~valid, 400).when(F.col("wins") & F.col("known").isNull(), 201).when(F.col("kind") == "seed", 200).otherwise(409)
    return judged.withColumns({"status": status, "message": F.when(status == 400, INVALID_INPUT).when(status == 409, EXISTS)})


def register_users(users: DataFrame, registrations: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(users, rejects)."""
    judged = judge_registrations(users, registrations)
    none = F.lit(None).cast("timestamp_ntz")
    made = {"_id": new_id(F.col("email")), "lastLoginAt": none, "createdAt": as_of, "updatedAt": as_of}
    added = judged.where("status = 201").select(*(made.get(c, F.col(c)).alias(c) for c in USERS.names))
    rejects = judged.where("status >= 400").select("seq", "email", "status", "message")
    return users.select(*USERS.names).unionByName(added), rejects


def judge_user_edits(users: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (seq, _id, name, email, role) with status and message; the last good edit of a user is applied."""
    asked = validate_users(edits.withColumns({"name": trimmed(F.col("name")), "email": normalize_email(F.col("email"))}))
    asked = asked.join(users.select("_id", F.lit(True).alias("found")), "_id", "left")
    asked = asked.join(users.select("email", F.col("_id").alias("owner")), "email", "left")
    valid = F.size("errors") == 0
    good = F.coalesce(valid & F.col("found") & (F.col("owner").isNull() | (F.col("owner") == F.col("_id"))), F.lit(False))
    asked = asked.withColumn("good", good)
    first = F.min(F.when(F.col("good"), F.struct("seq", "_id"))).over(among("good", "seq", "email"))
    last = F.max(F.when(F.col("good"), F.col("seq"))).over(among("good", "seq", "_id"))
    asked = asked.withColumns({"second": F.col("good") & (first["_id"] != F.col("_id")), "last": F.col("good") & (F.col("seq") == last)})
    status = F.when(~valid, 400).when(F.col("found").isNull(), 404).when(~F.col("good") | F.col("second"), 409).otherwise(200)
    said = F.when(status == 400, INVALID_INPUT).when(status == 404, NOT_FOUND).when(status == 409, OWNED)
    return asked.withColumns({"status": status, "message": said, "applied": F.col("last") & ~F.col("second")})


def _edited(users: DataFrame, judged: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(users, rejects) of judged edits, of which one a user has ``applied``."""
    fields = ["name", "email", "role"]
    applied = judged.where("applied").select("_id", *(F.col(c).alias(f"new_{c}") for c in fields), F.lit(True).alias("new"))
    columns = {c: F.when(F.col("new"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in fields}
    columns["updatedAt"] = F.when(F.col("new"), as_of).otherwise(F.col("updatedAt"))
    changed = users.join(applied, "_id", "left").select(*(columns.get(c, F.col(c)).alias(c) for c in USERS.names))
    return changed, judged.where("status <> 200").select("seq", "_id", "status", "message")


def update_users(users: DataFrame, edits: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(users, rejects)."""
    return _edited(users, judge_user_edits(users, edits), as_of)


def replay_user_edits(users: DataFrame, edits: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(users, rejects) of edits taken one after the other by seq, which is unique: an e-mail that an earlier edit has freed is free."""
    checked = validate_users(edits.withColumns({"name": trimmed(F.col("name")), "email": normalize_email(F.col("email"))}))
    owners = users.select(F.col("_id").alias("row"), F.col("email").alias("key"))
    return _edited(users, replayed(checked, users, "seq", F.col("email"), owners, NOT_FOUND, OWNED), as_of)


def delete_users(users: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(users, rejects); requests: (actorId, targetId).  Nobody deletes their own account."""
    known = users.select(F.col("_id").alias("targetId"), F.lit(True).alias("known"))
    asked = requests.join(known, "targetId", "left")
    status = F.when(F.col("actorId") == F.col("targetId"), 400).when(F.col("known").isNull(), 404).otherwise(200)
    asked = asked.withColumns({"status": status, "message": F.when(status == 400, SELF).when(status == 404, NOT_FOUND)})
    gone = asked.where("status = 200").select(F.col("targetId").alias("_id"))
    return users.join(gone, "_id", "left_anti"), asked.where("status <> 200").select("actorId", "targetId", "status", "message")


def fold_logins(users: DataFrame, events: DataFrame) -> DataFrame:
    """lastLoginAt raised to the latest login (email, portal, ts) whose portal is the user's role."""
    logins = events.select(normalize_email(F.col("email")).alias("email"), F.col("portal").alias("role"), "ts")
    latest = logins.groupBy("email", "role").agg(F.max("ts").alias("latest"))
    both = users.join(latest, ["email", "role"], "left").withColumn("lastLoginAt", F.greatest("lastLoginAt", "latest"))
    return both.select(*USERS.names)


def first_per_email(registrations: DataFrame) -> DataFrame:
    """One request an e-mail: the first."""
    return dedupe_batch(registrations.withColumn("email", normalize_email(F.col("email"))), ["email"], ["seq"], keep="first")
