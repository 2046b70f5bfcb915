"""Predicates grounded on texts by groups of words, with evidence, intensity and confidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.dates import period_end
from tessera.functions.text import evidence, first_of, matches_groups, sentences


@dataclass(frozen=True)
class Predicate:
    """Holds where every group has a word in the text."""

    name: str
    groups: tuple[tuple[str, ...], ...]
    direction: int = 1
    lag: int = 1


#: Macro transmission predicates of Chinese industry texts, their word groups, directions and lags in months.
MACRO = (
    Predicate("policy_expands_effective_demand", (("补贴", "以旧换新", "购置税", "采购", "消费", "需求"), ("支持", "扩大", "提升", "促进", "实施", "印发")), 1, 2),
    Predicate("policy_accelerates_project_implementation", (("项目", "工程", "基地", "建设"), ("开工", "落地", "审批", "核准", "提速", "加快", "推进")), 1, 2),
    Predicate("capacity_under_construction", (("产能", "生产线", "基地", "项目"), ("拟建", "在建", "建设", "扩产", "投资", "规划")), 1, 6),
    Predicate("capacity_enters_production", (("产能", "生产线", "项目", "基地"), ("投产", "达产", "量产", "正式生产", "投入运营")), 1, 1),
    Predicate("order_demand_improves", (("订单", "中标", "排产", "交付", "合同"), ("增长", "增加", "饱满", "提升", "签署", "中标")), 1, 1),
    Predicate("inventory_pressure_increases", (("库存", "去库", "积压"), ("上升", "增加", "高位", "压力", "放缓", "困难")), -1, 1),
    Predicate("product_price_recovers", (("价格", "报价", "加工费"), ("上涨", "上调", "回升", "修复", "改善", "提价")), 1, 1),
    Predicate("raw_material_cost_pressure", (("原材料", "锂", "硅料", "铜", "铝", "碳酸锂"), ("涨价", "上涨", "成本压力", "成本增加", "挤压")), -1, 1),
    Predicate("export_demand_improves", (("出口", "海外", "境外"), ("增长", "增加", "订单", "需求", "交付", "拓展")), 1, 1),
    Predicate("grid_investment_accelerates", (("电网", "特高压", "配电网", "输变电"), ("投资", "招标", "建设", "改造", "开工", "提速")), 1, 3),
    Predicate("financing_constraint_eases", (("融资", "授信", "贷款", "债券", "资金"), ("获批", "增加", "支持", "到位", "发行", "降低")), 1, 3),
    Predicate("industry_competition_intensifies", (("竞争", "价格战", "产能过剩", "供过于求", "内卷"), ("加剧", "激烈", "降价", "过剩", "淘汰", "承压")), -1, 1),
)


def ground(docs: DataFrame, predicates: tuple[Predicate, ...] = MACRO, reliability: Column | None = None, text: str = "text", day: str = "publish_time") -> DataFrame:
    """One row for each document and predicate: (doc_id, period_end, name, value, direction, intensity, confidence, lag, evidence_text).

    Intensity grows with evidence of 40 characters or more, confidence with the source's reliability and the share of distinct words.
    """
    trust, numbers = F.lit(0.6) if reliability is None else reliability, range(len(predicates))
    groups = [[list(g) for g in p.groups] for p in predicates]
    t, hit = F.col("__text"), lambda i: F.col(f"__hit_{i}")
    # step by step, as an exploded array would evaluate each of its parts anew: hits, then sentences of texts with any, then what only hits need
    read = docs.select("doc_id", period_end(F.col(day)).alias("period_end"), F.col(text).alias("__text"), trust.alias("__trust"))
    read = read.withColumns({f"__hit_{i}": F.coalesce(matches_groups(t, groups[i]), F.lit(False)) for i in numbers})
    some = F.lit(False)
    for i in numbers:
        some = some | hit(i)
    read = read.withColumn("__parts", F.when(some, sentences(t)))
    share = lambda g: F.least(F.size(F.array_distinct(F.array(*[first_of(t, w) for w in g]))) / len(g), F.lit(1.0))
    told = {f"__found_{i}": F.when(hit(i), evidence(t, groups[i], parts=F.col("__parts"))).otherwise("") for i in numbers} | {f"__share_{i}": F.when(hit(i), share(groups[i])) for i in numbers}
    read = read.select("doc_id", "period_end", "__trust", *[hit(i) for i in numbers], *[c.alias(n) for n, c in told.items()])

    def row(i: int, p: Predicate) -> Column:
        held, found, portion = hit(i), F.col(f"__found_{i}"), F.col(f"__share_{i}")
        return F.struct(
            F.lit(p.name).alias("name"), held.alias("value"), F.when(held, p.direction).otherwise(0).alias("direction"),
            F.when(held, 0.55 + 0.15 * portion + 0.10 * (F.length(found) >= 40).cast("int")).otherwise(0.0).alias("intensity"),
            F.when(held, F.least(0.45 + 0.35 * F.col("__trust") + 0.15 * portion, F.lit(0.95))).otherwise(F.least(F.lit(0.70), F.col("__trust"))).alias("confidence"),
            F.lit(p.lag).alias("lag"), found.alias("evidence_text"),
        )

    return read.select("doc_id", "period_end", F.explode(F.array(*[row(i, p) for i, p in enumerate(predicates)])).alias("p")).select("doc_id", "period_end", "p.*")
