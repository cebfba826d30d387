"""Constants and wording that results must reproduce exactly."""

from __future__ import annotations

# Monitored indicators with base level, daily phase (hour) and seasonal amplitude.
BASE_LEVEL = {"cod": 18.0, "ammonia": 0.7, "tp": 0.12, "cr6": 0.003, "ph": 7.3}
DAILY_PHASE = {"cod": 10, "ammonia": 8, "tp": 9, "cr6": None, "ph": 6}
SEASONAL_AMPLITUDE = {"cod": 0.12, "ammonia": 0.12, "tp": 0.12, "cr6": 0.0, "ph": 0.01}

# What-if scenarios.
SEVERITY_MULTIPLIER = {"low": 1.5, "medium": 2.0, "high": 2.5}
SUDDEN_SCALE = 1.0 / 12.0
SUDDEN_REFERENCE_KG = 80.0
DUMP_FLOW_MULTIPLIER = 6.0

# Weights of the kinds of evidence and thresholds of the verdict.
EVIDENCE_WEIGHTS = {"eem": 0.40, "pollutant": 0.25, "pattern": 0.20, "strength": 0.15}
REJECT_BELOW = 0.3
RESOLVE_FROM = 0.6

# Response steps by event type and advice by severity.
RESPONSE_STEPS = {
    "periodic": ["立即对该企业开展夜间突击执法检查", "核查排污许可证与在线监测数据",
                 "对特征污染物（重金属）开展加密监测", "必要时启用应急调蓄设施"],
    "sudden": ["启动突发水污染事件应急预案", "通知下游水厂停止取水并启用备用水源",
               "在下游断面加密监测（每2小时1次）", "组织泄漏源围堵与吸附处置"],
    "gradual": ["排查污水处理厂运行工况与进水水质", "核查上游管网与面源污染",
                "启动流域联合调度，增加生态补水", "对超标断面实施水质改善工程措施"],
    "detected": ["复核自动监测数据与实验室比对", "扩大监测范围排查潜在污染源"],
}
SEVERITY_ADVICE = {
    "low": "密切关注，加密监测",
    "medium": "启动应急响应，2小时内完成溯源",
    "high": "立即启动应急响应，通报下游并组织溯源",
}

# Reasons and suggestions of a failed verdict.
NO_SOURCE_REASON = "该断面上游未发现注册企业"
NO_SOURCE_SUGGESTIONS = ["建议增设监测断面"]
LOW_SCORE_REASON = "所有候选企业综合得分均低于锁定阈值（指纹匹配度不足）"
LOW_SCORE_SUGGESTIONS = ["建议在可疑支流增设临时监测断面", "建议加密采样做荧光全谱分析",
                         "建议联合生态环境部门开展暗管排查"]

# Regulation clauses (standard, clause, indicator, limit, unit, text).
REGULATION_COLUMNS = "pos INT, standard STRING, clause STRING, indicator STRING, limit STRING, unit STRING, text STRING"
REGULATIONS = [
    (0, "GB 3838-2002 地表水环境质量标准", "Ⅲ类水质限值", "cod", "20", "mg/L", "Ⅲ类水域 COD ≤ 20 mg/L。"),
    (1, "GB 3838-2002 地表水环境质量标准", "Ⅲ类水质限值", "ammonia", "1.0", "mg/L", "Ⅲ类水域氨氮 ≤ 1.0 mg/L。"),
    (2, "GB 3838-2002 地表水环境质量标准", "Ⅲ类水质限值", "tp", "0.2", "mg/L", "Ⅲ类水域总磷 ≤ 0.2 mg/L（河流）。"),
    (3, "GB 3838-2002 地表水环境质量标准", "Ⅲ类水质限值", "cr6", "0.05", "mg/L", "Ⅲ类水域六价铬 ≤ 0.05 mg/L。"),
    (4, "GB 3838-2002 地表水环境质量标准", "Ⅲ类水质限值", "ph", "6~9", "-", "pH 限值 6~9。"),
    (5, "中华人民共和国水污染防治法", "第六十五条", "general", "-", "-",
     "禁止向水体排放油类、酸液、碱液或者剧毒废液。"),
    (6, "中华人民共和国水污染防治法", "第八十三条", "general", "-", "-",
     "超过水污染物排放标准排放水污染物的，处十万元以上一百万元以下的罚款；情节严重的，报经有批准权的人民政府批准，责令停业、关闭。"),
    (7, "中华人民共和国水污染防治法", "第八十五条", "general", "-", "-",
     "利用渗井、渗坑、裂隙、溶洞，私设暗管，篡改、伪造监测数据，或者不正常运行水污染防治设施等逃避监管的方式排放水污染物的，"
     "责令改正或者责令限制生产、停产整治，并处十万元以上一百万元以下的罚款；情节严重的，报经有批准权的人民政府批准，责令停业、关闭。"),
]

# Labels of the investigation report.
REPORT = {
    "title": "# 水质污染溯源调查报告",
    "investigation": "- 调查编号：",
    "event": "- 事件编号：",
    "station": "- 预警断面：",
    "indicators": "- 异常指标：",
    "onset": "- 首达时间：",
    "steps": "## 一、调查过程（线索 → 推理 → 证据）",
    "clue": "- 线索：",
    "reasoning": "- 推理：",
    "evidence": "- 证据：",
    "suspects": "## 二、嫌疑排序",
    "conclusion": "## 三、结论",
    "locked": "**锁定污染源：",
    "confidence": "- 置信度：",
    "basis": "- 依据：",
    "not_locked": "**未能锁定单一污染源**",
    "reason": "- 原因：",
    "advice": "- 建议：",
    "opinions": "## 四、法规与处置意见",
}
COMPLIANCE_HEAD = "依据现行标准与法规，本次事件涉及以下条款："
COMPLIANCE_TAIL = "若确认人为偷排/事故性排放，可依据《水污染防治法》追究行政责任。"
