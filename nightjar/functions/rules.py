"""Detection rules and score-to-label expressions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nightjar.functions.columns import col

# ---- fixed values: rule branches (substring on the lower-cased type, first match wins)
R_LOGIN, R_LOGIN_TRAVEL, R_LOGIN_BADIP = 0.1, 0.7, 0.9
R_LISTBUCKETS = 0.2
R_CREATEUSER = 0.6
R_POLICY_PUBLIC, R_POLICY_OTHER = 0.9, 0.7
R_GET_SENSITIVE, R_GET_OTHER = 0.7, 0.3
R_ROLE_ADMIN, R_ROLE_OTHER = 1.0, 0.8
BAD_PREFIX = "5.199"
SENSITIVE_BUCKET = "secure-logs"
DEFAULT_WEIGHTS = {"rule": 0.4, "ueba": 0.25, "seq": 0.2, "ti": 0.15}
DEFAULT_THRESHOLD = 0.7
# -----------------------------------------------------------------------------------


def rule_score(event_type="event_type", region="region", prev_region="prev_login_region",
               source_ip="source_ip", policy="policy", bucket="bucket", role_arn="role_arn",
               travel: bool = True) -> Column:
    """R1-R7 as one CASE chain."""
    et = F.lower(F.coalesce(col(event_type), F.lit("")))
    ip = F.coalesce(col(source_ip), F.lit(""))
    login = F.lit(R_LOGIN)
    if travel:
        moved = col(prev_region).isNotNull() & col(region).isNotNull() & (col(region) != col(prev_region))
        login = F.when(moved, F.lit(R_LOGIN_TRAVEL)).otherwise(login)
    login = F.when(ip.startswith(BAD_PREFIX), F.lit(R_LOGIN_BADIP)).otherwise(login)
    return (F.when(et.contains("consolelogin"), login)
            .when(et.contains("listbuckets"), F.lit(R_LISTBUCKETS))
            .when(et.contains("createuser"), F.lit(R_CREATEUSER))
            .when(et.contains("putbucketpolicy"),
                  F.when(F.coalesce(col(policy), F.lit("")).contains("public-read"), F.lit(R_POLICY_PUBLIC))
                  .otherwise(F.lit(R_POLICY_OTHER)))
            .when(et.contains("getobject"),
                  F.when(F.coalesce(col(bucket), F.lit("")) == SENSITIVE_BUCKET, F.lit(R_GET_SENSITIVE))
                  .otherwise(F.lit(R_GET_OTHER)))
            .when(et.contains("assumerole"),
                  F.when(F.coalesce(col(role_arn), F.lit("")).contains("Admin"), F.lit(R_ROLE_ADMIN))
                  .otherwise(F.lit(R_ROLE_OTHER)))
            .otherwise(F.lit(0.0)))


def severity_hint(event_type="event_type") -> Column:
    et = col(event_type)
    return (F.when(et.isin("IAMPolicyChange", "EC2StartInstances"), F.lit("high"))
            .when(et == "AuthFailure", F.lit("medium")).otherwise(F.lit("low")))


def weighted_fusion(rule="rule_score", ueba="ueba_score", seq="seq_score", ti="ti_score",
                    weights: dict | None = None) -> Column:
    w = {k: v if isinstance(v, Column) else F.lit(float(v)) for k, v in (weights or DEFAULT_WEIGHTS).items()}
    return w["rule"] * col(rule) + w["ueba"] * col(ueba) + w["seq"] * col(seq) + w["ti"] * col(ti)


def mean_fusion(*components) -> Column:
    """Mean of non-null components, 0 when none."""
    cs = [col(c) for c in components]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cs[1:]), F.coalesce(cs[0], F.lit(0.0)))
    n = sum((c.isNotNull().cast("int") for c in cs[1:]), cs[0].isNotNull().cast("int"))
    return F.when(n > 0, total / n).otherwise(F.lit(0.0))


def final_score(*components) -> Column:
    """Max of fused and every component, clipped to [0, 1]."""
    return F.least(F.greatest(F.lit(0.0), F.greatest(*[F.coalesce(col(c), F.lit(0.0)) for c in components])),
                   F.lit(1.0))


def score_severity(score) -> Column:
    """> 0.7 high, >= 0.4 medium, else low."""
    s = col(score)
    return F.when(s > 0.7, F.lit("high")).when(s >= 0.4, F.lit("medium")).otherwise(F.lit("low"))


def identifier_type(rule="rule_score", ueba="ueba_score", seq="seq_score", ti="ti_score",
                    corr="corr_score") -> Column:
    """R13 priority: ti > 0.5; rule >= 0.8; corr >= 0.5; seq >= 0.5; ueba >= 0.5."""
    return (F.when(col(ti) > 0.5, F.lit("ti:ip_reputation"))
            .when(col(rule) >= 0.8, F.lit("rule:iam_change"))
            .when(col(corr) >= 0.5, F.lit("graph:correlation"))
            .when(col(seq) >= 0.5, F.lit("seq:anomaly"))
            .when(col(ueba) >= 0.5, F.lit("ueba:score"))
            .otherwise(F.lit("fused:combination")))
