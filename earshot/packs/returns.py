"""Label pack for return and after-sales remarks.

Fixed values: labels, keywords and their order decide the results.
"""

# ---- fixed values: validity ----------------------------------------------------

INVALID_MARKERS = ("", "na", "n/a", "none", "null", "同上", "sameasabove", "same as above", "未提供")
TRUE_MARKERS = ("1", "true", "yes", "y", "是")

# ---- fixed values: risk patterns -----------------------------------------------

HIGH_RISK = ("故障", "无法", "不工作", "失效", "保护", "静音", "断续", "噪音", "爆音", "电流声", "hdmi", "cec")
MEDIUM_RISK = ("兼容", "不匹配", "音量", "增益", "失真", "破音")
USER_REASONS = ("不再需要", "买错", "下错单", "替代品", "改变主意", "需求变化")
QUALITY_RISK = ("质量", "故障", "品质", "噪音", "兼容", "保护", "静音", "电源")

# ---- fixed values: macro themes --------------------------------------------------

RISK_CATEGORIES = (
    "质量/故障", "质量故障", "品质", "故障", "兼容性", "兼容性/连接问题", "兼容连接", "噪音", "噪音问题", "功能需求",
)
MACRO_THEMES = {
    "音质": "声音相关", "音质/性能体验": "声音相关", "音质体验": "声音相关", "噪音": "声音相关",
    "噪音问题": "声音相关",
    "质量/故障": "品质相关", "质量故障": "品质相关", "品质": "品质相关", "故障": "品质相关",
    "功能": "功能相关", "功能需求": "功能相关", "接口/连接": "功能相关",
    "兼容性": "兼容与适配", "兼容性/连接问题": "兼容与适配", "兼容连接": "兼容与适配",
    "用户": "用户与认知", "用户原因": "用户与认知",
    "页面/预期不符": "体验与认知", "页面预期不符": "体验与认知", "体验": "体验与认知",
    "价格": "价格与竞品", "价格/替代品/竞品": "价格与竞品", "价格竞品": "价格与竞品", "降价": "价格与竞品",
    "物流": "交付与包装", "物流包装": "交付与包装", "包装/配件/版本问题": "交付与包装",
}
MACRO_DEFAULT = "未归类"

# ---- fixed values: label chains, in priority order --------------------------------
# (level 1, level 2, level 3, level 4, keywords)

CHAIN_RULES = (
    ("质量/故障", "声道", "单声道或声道异常", "个体质量问题", ("单声道", "立体声失效", "声道异常", "one channel", "single channel")),
    ("质量/故障", "功能故障", "电源异常/无法正常通电", "个体质量问题", ("无法开机", "无法通电", "不通电", "电源异常", "power on")),
    ("质量/故障", "无法正常工作", "无法工作或进入保护静音", "个体质量问题", ("无法工作", "不工作", "没声音", "保护", "静音", "失效", "故障", "not working", "stopped working", "no sound", "dead")),
    ("质量/故障", "损坏", "到货或使用中损坏", "个体质量问题", ("损坏", "坏了", "broken")),
    ("兼容性/连接问题", "设备不支持HDMI CEC功能", "HDMI CEC 不支持", "兼容性适配问题", ("hdmi cec", "cec")),
    ("兼容性/连接问题", "与系统不兼容", "接口或系统接法不匹配", "兼容性适配问题", ("不兼容", "兼容", "不匹配", "断续", "接法", "hdmi", "compatible", "intermittent")),
    ("噪音", "噪声/底噪/电流声", "噪声增加或底噪明显", "硬件设计问题", ("噪音", "噪声", "底噪", "电流声", "爆音", "破裂音", "noise", "hum", "buzz", "static")),
    ("音质", "失真/破音", "播放失真或破音", "硬件设计问题", ("失真", "破音", "distortion")),
    ("用户原因", "下错单/买错型号", "型号或规格选错", "用户认知问题", ("买错", "下错单", "选错", "wrong order", "ordered the wrong")),
    ("用户原因", "找到替代品/更换其他产品", "已找到替代品", "用户认知问题", ("替代品", "found another")),
    ("用户原因", "需求变化/不再需要", "需求变化或不再需要", "用户认知问题", ("不再需要", "需求变化", "改变主意", "no longer needed", "changed my mind")),
    ("功能", "需要AirPlay功能", "缺少 AirPlay", "产品定义问题", ("airplay",)),
    ("功能", "Subwoofer相关功能问题", "低音炮相关能力缺失", "产品定义问题", ("subwoofer", "低音炮", "高通滤波")),
    ("功能", "音量/增益控制问题", "音量或增益逻辑不合理", "产品定义问题", ("音量", "增益", "volume", "gain", "耳机口")),
    ("页面/预期不符", "与描述不一致", "页面描述与实际不符", "页面表达问题", ("与描述不符", "描述不一致", "误导", "not as described", "misleading")),
    ("页面/预期不符", "疑似二手/包装问题", "疑似二手或非全新", "仓配/版本管理问题", ("二手", "非全新", "used item")),
    ("价格/替代品/竞品", "同款降价", "购买后降价", "产品定义问题", ("降价", "price drop")),
    ("价格/替代品/竞品", "竞品/替代方案", "竞品更便宜", "产品定义问题", ("竞品", "更便宜", "cheaper")),
    ("物流", "包装损坏", "配送或包装问题", "仓配/版本管理问题", ("物流", "延迟送达", "包装", "配件", "late delivery", "missing parts")),
    ("音质", "音质预期不符", "声音表现与预期存在落差", "产品定义问题", ("音质", "声音差", "刺耳", "声场", "解析", "sound quality")),
    ("页面/预期不符", "整体体验不达预期", "整体体验未达预期", "页面表达问题", ("预期", "失望", "i expected", "disappointed")),
)
UNSURE_LABEL = "待人工判定"
UNSURE_CAUSE = "暂无法判断"
REVIEW_LABELS = ("待人工复核", "待人工判定", "暂无法判断", "NA")

# ---- fixed values: older names and short display names ------------------------------

LEGACY_LEVEL_1 = {
    "用户问题": "用户原因", "故障": "质量/故障", "兼容": "兼容性/连接问题", "价格问题": "价格/替代品/竞品",
}
DISPLAY_LEVEL_1 = {
    "质量/故障": "质量故障", "音质/性能体验": "音质体验", "兼容性/连接问题": "兼容连接",
    "价格/替代品/竞品": "价格竞品", "页面/预期不符": "页面预期不符",
}

# ---- fixed values: output columns ------------------------------------------------------

FEEDBACK_COLUMNS = (
    "record_id", "product_name", "source_type", "source_sheet", "source_row", "return_time", "store",
    "country", "raw_comment", "translated_comment", "return_reason", "cleaned_comment",
    "is_valid_feedback", "level_1", "level_2", "level_3", "level_4", "severity", "is_user_reason",
    "is_quality_risk",
)

# ---- fixed values: model codes ------------------------------------------------------------

MODEL_CODE = (
    r"(?:BOX\s*X\d+|LC\d{2,3}|GR\d{2,3}|ZD\d{1,3}|ZA\d{1,3}|ZP\d{1,3}|MC\d{2,3}|P\d{1,3}|Q\d{1,3}"
    r"|BT\d+[A-Z]*|K\d+[A-Z]*)"
)
