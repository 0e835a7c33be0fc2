"""Whether a model may be asked: ordered rules over what is known of it, the first that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rules in their order. A rule holds where all flags that it names are as it says.
RULES = (
    ("unknown provider", {"registered": False}, "that provider is not registered", None),
    ("local only", {"is_local": False, "local_only": True}, "a cloud provider, and local-only mode is on", "Turn off Local-Only Mode in the privacy settings, or choose a local model."),
    ("offline", {"is_local": False, "online": False}, "an internet connection is needed", "Use local sources and a local model until you are online again."),
    ("not configured", {"is_local": False, "configured": False}, "there is no key for the provider", "Add a key in the settings."),
    ("no consent", {"is_local": False, "consent": False}, "sending to a cloud provider was not agreed to", "Agree to it in the privacy settings, or choose a local model."),
    ("no model", {"is_local": True, "configured": False}, "no local model is configured", "Choose a model in the settings."),
    ("unreachable", {"reachable": False}, "the provider did not answer", "Start it, or try again later."),
)
READY = "ready"
FLAGS = ("registered", "is_local", "local_only", "online", "configured", "consent", "reachable")


def decision(flags: dict[str, Column]) -> Column:
    """(state, reason, recovery) of a request with these flags; an unknown flag stands in no rule's way but those that ask for it.

    Rules are a few literals, so the first that holds is the least by place of those that do, in the row itself."""
    held = []
    for place, (state, wanted, reason, recovery) in enumerate(RULES):
        holds = F.lit(True)
        for name, value in wanted.items():
            holds = holds & F.coalesce(flags[name] == F.lit(value), F.lit(False)) if name in flags else F.lit(False)
        held.append(F.when(holds, F.struct(F.lit(place).alias("place"), F.lit(state).alias("state"), F.lit(reason).alias("reason"), F.lit(recovery).cast("string").alias("recovery"))))
    first = F.array_min(F.array_compact(F.array(*held)))
    return F.struct(F.coalesce(first["state"], F.lit(READY)).alias("state"), first["reason"].alias("reason"), first["recovery"].alias("recovery"))


def page_failure(status: Column, blocked: Column, length: Column, client_rendered: Column) -> Column:
    """Why a fetched page is no document, or null: by its status, what its gate says, and how much text it gave."""
    said = F.lower(F.coalesce(blocked, F.lit("")))
    return (
        F.when(said.contains("403"), F.lit("download failed"))
        .when(said.rlike("sign|paywall|subscri"), F.lit("sign-in required"))
        .when(~status.between(200, 299), F.lit("download failed"))
        .when((length == 0) & client_rendered, F.lit("needs a browser"))
        .when(length < 80, F.lit("no readable text"))
    )
