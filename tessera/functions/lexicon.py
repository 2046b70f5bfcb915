"""Word lists of the fixed schemas that texts are grounded on.

Fixed values: names, words, patterns and texts below must stand as they are for results to agree; they are parameters of the operators that use them.
"""

#: What follows this mark in a text is a note on how it was found, and no evidence.
NOTE_MARK = "项目关联："

#: Words of each futures-research predicate, in the order of the schema.
RESEARCH = {
    "supply_disruption": ("停产", "减产", "事故", "检修", "环保限产", "供应中断"),
    "supply_expansion": ("扩产", "新增产能", "投产", "产能释放", "产量增长"),
    "production_resumption": ("复产", "恢复生产", "恢复供应"),
    "demand_ev_positive": ("新能源汽车销量增长", "电动车销量增长", "动力电池排产增长", "以旧换新"),
    "demand_storage_positive": ("储能装机增长", "储能招标", "储能电池排产", "新型储能规模化"),
    "demand_weak_or_price_war": ("需求疲弱", "需求下降", "价格战", "减产去库", "订单下滑"),
    "inventory_drawdown": ("库存下降", "去库存", "库存去化"),
    "inventory_build": ("库存增加", "库存累积", "库存上升", "累库"),
    "warehouse_receipt_decline": ("仓单减少", "仓单下降", "注销仓单"),
    "warehouse_receipt_increase": ("仓单增加", "仓单上升", "注册仓单"),
    "policy_demand_support": ("购置税减免", "消费补贴", "以旧换新", "储能规模化", "政策支持"),
    "import_supply_pressure": ("进口增长", "进口量增加", "到港增加"),
    "cost_support": ("成本上升", "矿价上涨", "加工费上涨", "成本支撑"),
    "delivery_pressure": ("交割压力", "可交割货源", "仓单集中", "临近交割"),
    "authoritative_source": ("国务院", "国家发展改革委", "国家能源局", "工业和信息化部", "广期所", "广州期货交易所", "上市公司", "公告", "政府网", "交易所"),
    "quantitative_evidence": (),
    "uncertainty_high": ("尚需审批", "存在不确定性", "传闻", "预计", "可能", "风险提示"),
}
QUANTITY = r"(?i)\d+(?:\.\d+)?(?:%|万吨|吨|亿元|万辆|GWh|GW|套|家|个)"
QUANTITY_WITH_COMMAS = r"(?i)\d+(?:[,.]\d+)*(?:%|万吨|吨|亿元|万辆|GWh|GW|手|台|个)"
STORAGE_GROWTH = ("投产", "新增产能", "产能释放", "装机增长")

#: Words of event types, tried in this order; then those of policies and of attention in the news.
EVENT_TYPES = {
    "regulatory_penalty": ("行政处罚", "立案调查", "纪律处分", "监管措施"),
    "inquiry_letter_pressure": ("问询函", "关注函", "监管函"),
    "earnings_quality_anomaly": ("业绩预亏", "业绩亏损", "资产减值", "会计差错", "财务造假"),
    "supply_chain_disruption": ("停产", "复产", "生产事故", "供应中断", "不可抗力"),
    "product_price_increase": ("产品涨价", "价格上调", "调高价格", "调价函"),
    "capacity_expansion": ("扩产", "新增产能", "产能建设", "项目投产", "投资建设", "建设项目", "重大合同", "中标项目", "订单落地", "募投项目"),
}
POLICY_ACTIONS = ("行动方案", "实施方案", "补贴", "税收优惠", "以旧换新", "消纳责任权重", "并网", "市场交易", "试点示范", "指导意见")
ATTENTION = ("装机量", "装车量", "渗透率", "出口量", "招标规模", "行业自律", "供需变化", "价格变化", "市场关注", "规模以上工业增加值")
RISK_EVENTS = ("regulatory_penalty", "inquiry_letter_pressure", "earnings_quality_anomaly", "supply_chain_disruption")

#: Sectors: what their events are about, how these act, core products, and words that name the sector.
SECTORS = {
    "光伏": ("光伏组件、逆变器与可再生能源消纳", "政策/需求变化→光伏装机与组件/逆变器需求→产业链关注提升", ("光伏", "硅料", "硅片", "电池", "组件", "N 型", "TOPCon", "HJT"), ("光伏", "太阳能组件", "硅片", "晶硅")),
    "锂电": ("动力电池与锂电材料", "新能源汽车/储能需求→电池装车与材料需求→产业链景气度关注", ("动力电池", "锂电", "电池", "材料", "隔膜", "钠离子", "装车量"), ("动力电池", "锂离子电池", "锂电", "电池回收")),
    "风电": ("风电设备订单与项目交付", "项目核准/招标改善→风机订单与交付→设备链关注提升", ("风电", "海上风电", "风机", "叶片", "机组"), ("海上风电", "风电", "风机")),
    "储能": ("新型储能系统与逆变器", "新型储能建设→系统集成与逆变器需求→订单关注提升", ("储能", "逆变器", "系统集成", "大储", "户储"), ("新型储能", "储能系统", "储能项目", "储能装机")),
    "整车": ("新能源汽车销售与车型供给", "政策活动/需求变化→终端销量关注→整车与电池链条联动", ("新能源汽车", "整车", "车型", "销量", "出口", "插混"), ("新能源汽车", "汽车以旧换新", "充换电", "车网互动")),
}

#: Media and offices that count as authoritative, and major media.
MAJOR_MEDIA = ("证券时报", "上海证券报", "中国证券报", "21 世纪经济报道")
AUTHORITATIVE_KINDS, AUTHORITATIVE_NAMES = ("policy", "announcement", "ir_qa"), ("国家统计局", *MAJOR_MEDIA)
OFFICES = ("中国政府网", "国务院", "国家统计局", "发改委", "工信部", "财政部", "商务部", "上交所", "深交所")

#: Words and patterns of the predicates of an event.
POLICY_FORM, POLICY_MATTER = ("印发", "通知", "意见", "方案", "支持"), ("补贴", "规划", "专项行动", "实施意见", "指导意见", "工作方案", "扶持")
FOLLOW_UP, FOLLOW_UP_FACTS = ("后续", "进一步", "部署", "跟进"), ("行动方案", "试点", "以旧换新", "设备更新", "招标规模", "装机量", "装车量", "渗透率")
QUESTIONS, UNCERTAINTY = ("投资者提问", "互动易", "上证e互动", "追问"), ("不确定", "风险", "可能影响", "提示")
DEMAND_SIDE, SUPPLY_SIDE, CAPACITY = ("消费", "购置税", "补贴", "以旧换新", "销量", "需求", "车辆购置"), ("供给", "产业链", "制造", "设备更新", "技术改造", "绿色制造"), ("产能", "扩产", "项目", "设备更新")
TARGET_NUMBER, TARGET_WORDS = r"\d+(\.\d+)?\s*(元|万元|亿元|%|％|GWh|GW|兆瓦|万千瓦|吉瓦|千瓦|辆|台|万吨)", ("目标", "力争", "不低于", "达到")
EXPORT, INDUSTRY, BINDING = ("出口", "海外", "国际市场", "外销", "出海", "出口量", "外贸"), ("行业", "产业", "产业链", "全国", "多家企业", "全行业", "龙头"), ("强制", "必须", "不得", "严禁", "限期", "责令")

#: Confidence of each event predicate where it holds, and where it doesn't.
EVENT_PREDICATES = {
    "has_policy_support": (0.96, 0.88),
    "policy_directly_related_to_business": (0.90, 0.78),
    "event_mentions_core_product": (0.88, 0.74),
    "evidence_from_authoritative_source": (0.94, 0.72),
    "event_policy_binding_strength": (0.82, 0.70),
    "source_company_announcement": (0.94, 0.78),
    "source_major_media": (0.90, 0.76),
    "event_scale_industry_level": (0.84, 0.72),
    "policy_attention_followup": (0.84, 0.70),
    "event_mentions_export": (0.84, 0.72),
    "investor_questions_increase": (0.86, 0.82),
    "event_has_quantitative_target": (0.84, 0.72),
    "announcement_contains_uncertainty": (0.84, 0.78),
    "risk_or_uncertainty_disclosure": (0.86, 0.78),
    "demand_side_policy": (0.86, 0.74),
    "supply_side_policy": (0.84, 0.74),
    "capacity_policy_support": (0.84, 0.74),
}

#: Specificity: words or patterns of an action, a subject, a quantity, and a date or project.
ACTIONS = ("印发", "公告", "签署", "中标", "投资", "建设", "处罚", "问询", "计提", "投产", "发布")
SUBJECT, FACT_NUMBER, DATED_FACT = r"部|委|局|政府|交易所|公司|集团|股份有限公司", r"(?i)\d+(?:\.\d+)?\s*(?:%|亿元|万元|万千瓦|GW|GWh|万吨|亿平方米|个)", r"20\d{2}年|20\d{2}-\d{2}-\d{2}|项目|方案|合同|规划"
EVIDENCE_WORDS = ("政策", "订单", "产能", "储能", "电池", "光伏", "风电", "销量", "投资者")

#: Themes beyond one sector: word, its sectors, and how the theme is called; the first that a text holds counts.
THEMES = (
    ("新能源汽车", ("整车", "锂电"), "新能源汽车产业链"),
    ("电动汽车", ("整车", "锂电", "储能"), "电动汽车与充换电链条"),
    ("充电设施", ("整车", "储能"), "充电设施服务能力"),
    ("车网互动", ("整车", "储能"), "车网互动"),
    ("消费品以旧换新", ("整车",), "消费品以旧换新中的汽车消费"),
    ("汽车标准化", ("整车",), "汽车标准化"),
    ("汽车产业", ("整车",), "汽车产业政策"),
    ("节能降碳", ("光伏", "风电", "储能"), "节能降碳行动"),
    ("非化石能源", ("光伏", "风电"), "非化石能源消费"),
    ("能源工作指导意见", ("光伏", "风电", "储能"), "能源工作指导意见"),
    ("新能源消纳", ("光伏", "风电", "储能"), "新能源消纳"),
    ("可再生能源", ("光伏", "风电"), "可再生能源"),
    ("绿证", ("光伏", "风电"), "绿色电力证书"),
    ("绿色电力", ("光伏", "风电"), "绿色电力"),
    ("新能源上网电价", ("光伏", "风电"), "新能源上网电价"),
    ("新型电力系统", ("光伏", "风电", "储能"), "新型电力系统"),
    ("新型能源体系", ("光伏", "风电", "储能"), "新型能源体系"),
    ("配电网", ("光伏", "储能"), "配电网高质量发展"),
    ("电力系统调节", ("储能", "光伏", "风电"), "电力系统调节能力"),
    ("调节能力", ("储能",), "电力系统调节能力"),
    ("全国电力工业统计", ("光伏", "风电"), "电力工业统计中的新能源装机"),
    ("全国电力统计数据", ("光伏", "风电"), "电力统计中的新能源装机"),
    ("并网运行情况", ("光伏", "风电"), "可再生能源并网运行"),
    ("绿色低碳", ("光伏", "锂电", "储能"), "绿色低碳先进技术"),
    ("制造业绿色化", ("光伏", "锂电", "储能"), "制造业绿色化"),
)
#: Confidence of links: by name in the title, alias in the title, name in the text, alias in the text; by sector and theme for policies and for news.
DIRECT_LINK, SECTOR_LINK, THEME_LINK, THEME_ENTITIES = (0.98, 0.95, 0.91, 0.84), (0.78, 0.70), (0.64, 0.58), 2
