"""Fixed values of the checks: thresholds, word lists and substitution tables."""

# Thresholds of the similarity check.
ZH_SHINGLE, EN_SHINGLE = 8, 6
ZH_SIM_THRESHOLD, EN_SIM_THRESHOLD = 0.30, 0.25
MIN_SENT_UNITS, MIN_LIBRARY_UNITS = 6, 4
COVERAGE_FLOOR = 0.2
RECALL_CUT, TOP_SOURCES = 200, 3
FRAGMENT_GAP = 1
QUOTE_SHARE = 0.6
VARIANT_BITS = 12

# Thresholds of the machine-text score and its language model.
AIGC_HIGH, AIGC_MID = 70, 45
SENTENCE_ANCHOR, TOKEN_ANCHOR = 0.50, 0.32
ADD_K = 0.4
MIN_LM_TOKENS = 8
PARAGRAPH_GAP = 40

# Selection of sentences for the web check.
WEB_MIN_CHARS, WEB_MIN_WORDS = 12, 8
WEB_COUNT, WEB_PAGE_CHARS = 10, 150_000

# Service limits.
RATE_LIMIT, RATE_WINDOW_S = 300, 60
FAIL_LIMIT, FAIL_WINDOW_S, BAN_S = 5, 600, 900
PROGRESS_TTL_S = 180
CHUNK_UNITS = 380

# Phrases counted by the machine-text score.
ZH_CONNECTORS = (
    "因此", "然而", "此外", "同时", "综上所述", "总而言之", "首先", "其次", "再次", "最后", "一方面", "另一方面", "值得注意的是", "与此同时", "更重要的是", "不仅如此",
    "随着", "基于此", "由此可见", "换句话说",
)
ZH_CLICHES = (
    "具有重要意义", "重要的理论意义", "实践意义", "奠定坚实基础", "提供有力支持", "发挥着重要作用", "发挥重要作用", "广泛应用", "深入研究", "不断涌现", "日益增长", "密切相关",
    "取得显著成效", "有效提升", "不断优化", "日趋完善", "提供了新的思路", "新的机遇和挑战", "可持续发展", "高质量发展", "深度融合", "助力", "赋能", "全方位", "多层次", "多角度",
    "深入探讨", "进行了系统", "进行了深入研究", "旨在", "本文将从", "综上所述", "值得注意的是", "需要指出的是", "不难发现", "由此可见", "显而易见",
)
EN_CONNECTORS = (
    "however", "moreover", "furthermore", "additionally", "in conclusion", "overall", "therefore", "thus", "firstly",
    "secondly", "thirdly", "nevertheless", "in addition", "on the other hand", "in summary", "consequently",
    "as a result", "for instance", "for example", "notably",
)
EN_CLICHES = (
    "it is important to note", "plays a crucial role", "plays a vital role", "in today's", "delve into", "leverage",
    "comprehensive understanding", "a testament to", "ever-evolving", "navigate the", "foster", "underscore",
    "pave the way", "significant impact", "in the realm of", "it is worth noting", "landscape of", "multifaceted",
    "robust", "seamless", "holistic", "paradigm shift", "cutting-edge", "in summary",
)

# Substitutions of the rewriter.
CLICHE_ZH = {
    "综上所述": "从以上分析来看",
    "总而言之": "概括起来讲",
    "值得注意的是": "需要留意的一点是",
    "需要指出的是": "这里要说明的是",
    "具有重要意义": "有实际价值",
    "奠定坚实基础": "打下了基础",
    "提供有力支持": "提供了支持",
    "日益增长": "越来越多",
    "不断涌现": "陆续出现",
    "密切相关": "关系紧密",
    "取得显著成效": "效果明显",
    "日趋完善": "越来越完善",
    "深度融合": "深度结合",
    "深入探讨": "详细讨论",
    "深入研究": "细致研究",
    "进行了深入研究": "做了细致研究",
    "进行了系统研究": "做了系统梳理",
    "提供新的思路": "给出了一条可行思路",
    "机遇和挑战": "机会与难题",
    "发挥重要作用": "起到关键作用",
    "全方位": "多方面",
    "多层次": "分层次",
    "赋能": "带动",
    "助力": "推动",
}
CLICHE_EN = {
    "it is important to note that": "notably,",
    "it is worth noting that": "notably,",
    "plays a crucial role in": "is key to",
    "plays a vital role in": "is key to",
    "in conclusion": "to sum up",
    "delve into": "look into",
    "leverage": "use",
    "utilize": "use",
    "comprehensive": "thorough",
    "pivotal": "key",
    "robust": "strong",
    "foster": "encourage",
    "underscore": "highlight",
    "pave the way for": "open the door to",
    "in the realm of": "in",
    "ever-evolving": "fast-changing",
    "multifaceted": "varied",
    "holistic": "overall",
    "seamless": "smooth",
    "cutting-edge": "recent",
    "landscape of": "field of",
    "moreover": "also",
    "furthermore": "besides",
}
SYN_ZH = {
    "研究表明": "已有研究显示",
    "结果显示": "数据上看",
    "随着": "伴随",
    "提升": "提高",
    "促进": "推动",
    "导致": "引发",
    "因此": "为此",
    "此外": "另外",
    "应用": "运用",
    "采用": "使用",
    "显著": "明显",
    "影响": "作用",
    "探讨": "讨论",
    "目前": "当前",
    "大量": "许多",
    "主要": "核心",
    "以及": "和",
    "通过": "借助",
    "基于": "依据",
    "进一步": "更深入地",
}
SYN_EN = {
    "significant": "notable",
    "demonstrate": "show",
    "investigate": "examine",
    "examine": "look at",
    "individuals": "people",
    "approximately": "about",
    "numerous": "many",
    "additionally": "also",
    "subsequently": "later",
    "primarily": "mainly",
    "frequently": "often",
    "currently": "at present",
    "obtain": "get",
    "assist": "help",
    "require": "need",
    "indicate": "suggest",
}
CONNECTOR_HEADS_ZH = ("此外，", "同时，", "因此，", "然而，", "与此同时，")
