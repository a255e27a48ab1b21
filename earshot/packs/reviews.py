"""Keyword and label pack for product reviews.

Everything below is a fixed value: the labels and keywords decide the results,
so they are listed as they are.  Order matters in every rule list (first match
wins); a caller may pass an own pack with the same attributes.
"""

# ---- fixed values: drop rules ------------------------------------------------

EMPTY_MARKERS = ("", "na", "n/a", "none", "null")

FILLERS = (
    "good", "great", "nice", "ok", "okay", "fine", "works", "perfect", "bad", "poor", "loveit",
    "不错", "很好", "好", "可以", "满意", "一般", "垃圾", "很好用",
)

SPAM = (
    "coupon", "promo code", "discount code", "contact me", "whatsapp", "telegram", "free sample",
    "cashback", "返现", "优惠码", "加微信", "联系我", "广告", "推广",
)

SERVICE = (
    "fast shipping", "shipping was fast", "delivery was fast", "arrived on time", "arrived early",
    "packaged well", "customer service", "seller was great", "物流很快", "配送很快", "包装完好",
    "客服很好", "卖家很好",
)

PRODUCT_SIGNALS = (
    "sound", "audio", "switch", "volume", "button", "noise", "quality", "compatible", "setup",
    "speaker", "headphone", "tv", "turntable", "preamp", "fit", "function", "works with",
    "音质", "切换", "音量", "噪音", "兼容", "按钮", "安装", "扬声器", "耳机", "电视", "转盘", "前级", "功能",
)

# ---- fixed values: emotion word lists ---------------------------------------

STRONG_POSITIVE = (
    "perfect", "finally", "exactly what i needed", "game changer", "brilliant", "love", "excellent",
    "amazing", "完美", "终于", "正是我需要的", "惊喜", "优秀", "太棒了", "非常适合",
)
POSITIVE = (
    "good", "great", "works well", "easy", "useful", "helpful", "clean", "clear", "solid",
    "不错", "很好", "简单", "方便", "有用", "好用", "清晰",
)
STRONG_NEGATIVE = (
    "garbage", "trash", "useless", "unusable", "broken", "dead", "垃圾", "无法使用", "没声音", "坏了",
    "失效", "退货",
)
NEGATIVE = (
    "bad", "noise", "hum", "buzz", "static", "crackle", "distortion", "delay", "issue", "problem",
    "annoying", "poor", "负担", "噪音", "电流声", "静电", "爆音", "问题", "差", "不稳定", "不兼容", "失真",
    "延迟",
)
CONVENIENCE = (
    "easy", "convenient", "quick", "finally", "simple", "方便", "简单", "快速", "终于", "省事",
)
NOISE = (
    "noise", "hum", "buzz", "static", "crackle", "distortion", "噪音", "底噪", "电流声", "静电", "爆音",
    "失真",
)
CONTROL = (
    "volume", "mute", "button", "knob", "gain", "音量", "静音", "按钮", "旋钮", "增益",
)
CONNECT = (
    "connect", "compatible", "adapter", "rca", "xlr", "toslink", "spdif", "接口", "兼容", "连接", "接法",
)
VALUE = ("price", "worth", "cheap", "expensive", "价格", "值", "性价比", "便宜", "贵")
SURPRISE = (
    "finally", "exactly what i needed", "never thought", "surprised", "perfect", "正是我需要的", "终于",
    "没想到", "惊喜", "完美",
)

# ---- fixed values: viewpoint word lists --------------------------------------

DEFECT = (
    "doesn't work", "doesnt work", "not working", "stopped working", "no sound", "one channel",
    "single channel", "failed after", "dead", "broken", "contact issue", "不起作用", "没声音", "停止工作",
    "坏了", "单声道", "声道异常", "接触不良",
)
SUGGESTION = (
    "should", "wish", "would be better", "needs to", "need more", "i hope", "建议", "希望", "如果能",
    "应该", "最好", "需要增加",
)
COMPARE = (
    "better than", "worse than", "compared to", "compared with", "instead of", "more than", "less than",
    "比", "相比", "替代", "取代", "对比",
)
EXPECTATION = (
    "not as described", "i expected", "i thought", "misleading", "expected more", "description",
    "与描述不符", "预期", "以为", "误导", "没想到",
)
HYPE = (
    "best ever", "life changing", "unbelievable", "must buy", "绝对必买", "神作", "无敌", "吹爆",
)
AHA_PHRASES = (
    "i use this to", "finally", "exactly what i needed", "正是我需要的", "终于", "我用它来",
)

# ---- fixed values: ordered rules (label, keywords) ---------------------------

FEATURE_RULES = (
    ("音量", ("volume", "mute", "button", "knob", "remote", "gain", "音量", "静音", "按钮", "旋钮", "遥控", "增益")),
    ("音质", ("sound", "noise", "hum", "buzz", "static", "quality", "distortion", "latency", "delay", "音质", "噪音", "底噪", "失真", "延迟", "性能")),
    ("连接", ("connect", "compatible", "adapter", "hdmi", "usb", "rca", "xlr", "toslink", "spdif", "接口", "兼容", "连接", "接法")),
    ("体积", ("compact", "small", "desk", "desktop", "space", "setup", "install", "small footprint", "小巧", "紧凑", "桌面", "布置", "安装")),
    ("做工", ("build", "metal", "plastic", "sturdy", "durable", "broken", "quality", "做工", "耐用", "结构", "金属", "塑料", "质量")),
    ("价格", ("price", "cheap", "expensive", "value", "worth", "价格", "贵", "便宜", "值", "性价比")),
    ("外观", ("design", "look", "appearance", "label", "indicator", "led", "外观", "设计", "标识", "灯")),
    ("前级", ("preamp", "phono", "vinyl", "turntable", "amplifier", "唱机", "黑胶", "转盘", "前级", "放大")),
    ("场景", ("i use this to", "works with", "pair with", "route between", "用它来", "搭配", "组合", "玩法", "场景")),
    ("切换", ("switch", "selector", "route", "routing", "splitter", "input", "output", "切换", "切换器", "路由", "分配")),
)
FEATURE_DEFAULT = "基础"

NEED_RULES = (
    ("降摩擦", ("unplug", "switch between", "quickly", "finally", "one button", "不再反复插拔", "快速切换", "一步", "省事", "方便")),
    ("连接确定性", ("compatible", "works with", "connection", "stable signal", "兼容", "接法", "连接稳定", "信号稳定")),
    ("控制确定性", ("volume", "mute", "gain", "control", "predictable", "音量", "静音", "增益", "可控", "可预期")),
    ("音质稳定", ("sound quality", "clean sound", "no noise", "clear", "quality", "音质", "无噪音", "清晰", "性能")),
    ("稳定可靠", ("reliable", "durable", "last", "stopped working", "broken", "稳定", "可靠", "耐用", "故障", "失效")),
    ("空间效率", ("compact", "small", "hide", "desk", "space", "小巧", "紧凑", "省空间", "隐藏")),
    ("系统补足", ("turntable", "phono", "old receiver", "old system", "lack", "转盘", "黑胶", "旧系统", "补足", "补耳机口")),
    ("场景适配", ("multiple devices", "different outputs", "different sources", "versatile", "多设备", "多音源", "多场景", "灵活")),
    ("性价比安全感", ("price", "worth", "cheap", "expensive", "价格", "值", "性价比")),
    ("灵感启发", ("never thought", "surprised", "creative", "没想到", "惊喜", "灵感", "新玩法")),
    ("品质认同", ("premium", "quality feel", "build quality", "精致", "高级", "质感", "品质感")),
)
NEED_BY_FEATURE = {
    "切换": "降摩擦", "连接": "连接确定性", "音量": "控制确定性", "音质": "音质稳定", "体积": "空间效率",
    "做工": "稳定可靠", "价格": "性价比安全感", "外观": "品质认同", "前级": "系统补足", "场景": "灵感启发",
}
NEED_DEFAULT = "场景适配"

SCENE_RULES = (
    ("桌面双机", ("office", "work from home", "desktop", "computer", "pc", "mac", "zoom", "desk", "办公", "居家办公", "电脑", "桌面", "会议")),
    ("耳机音箱切换", ("headphone", "speaker", "headset", "earbud", "earphone", "耳机", "扬声器", "音箱")),
    ("家庭影音补足", ("tv", "television", "soundbar", "receiver", "home theater", "living room", "电视", "家庭影院", "客厅", "条形音箱", "光纤")),
    ("黑胶系统升级", ("turntable", "vinyl", "record", "phono", "old receiver", "唱机", "黑胶", "转盘", "旧系统")),
    ("录音创作", ("daw", "ableton", "protools", "synth", "keyboard", "guitar", "mixer", "broadcast", "录音", "直播", "创作", "合成器", "乐器")),
    ("游戏主机", ("xbox", "ps3", "ps4", "ps5", "wii", "console", "game", "游戏", "主机")),
    ("DIY项目", ("arduino", "raspberry", "robot", "relay", "project", "automation", "树莓派", "项目", "自动化", "模块")),
    ("小空间部署", ("small", "compact", "apartment", "bedroom", "tiny desk", "小巧", "卧室", "小空间", "紧凑")),
)
SCENE_DEFAULT = "通用补洞"

# scene: (persona, place, motivation, chain)
SCENE_TEMPLATES = {
    "桌面双机": ("桌面多设备用户", "书桌或办公桌前", "在工作与娱乐设备之间快速切换", "在书桌前面对多设备输入输出，用户希望减少反复插拔和设置切换，快速进入正确的音频路径"),
    "耳机音箱切换": ("耳机与外放频繁切换的桌面用户", "电脑桌或监听位", "在私密聆听与外放之间无缝切换", "用户在同一套设备上交替使用耳机和音箱，希望一键完成切换且不破坏音质"),
    "家庭影音补足": ("家庭影音用户", "客厅电视或家庭影院旁", "给电视或旧影音系统补足缺失接口和控制能力", "用户在电视、条形音箱和耳机之间搭桥，希望补足现代电视缺少的独立音频控制"),
    "黑胶系统升级": ("黑胶或旧系统爱好者", "唱盘与功放之间", "让旧设备重新接入现代系统并保住听感", "用户围绕转盘、前级和功放重建链路，希望旧设备能够被现代系统继续使用"),
    "录音创作": ("创作者或录音用户", "录音台或工作站", "在监听、输出和表演设备之间灵活调度", "用户在创作链路里需要快速切换监听和输出，不想因路由成本打断创作"),
    "游戏主机": ("游戏或主机用户", "游戏桌或娱乐角", "在主机、显示器和声音输出之间保持顺滑体验", "用户需要让主机或娱乐设备接入现有声音链路，减少折腾和兼容问题"),
    "DIY项目": ("DIY 或自动化项目制作者", "工作台或项目箱体内", "在有限空间内实现稳定的信号控制", "用户把模块嵌入项目本体，希望结构薄、接线直观、功能确定"),
    "小空间部署": ("小空间布置用户", "卧室、出租屋或紧凑桌面", "以最低布置成本解决功能缺口", "用户在有限空间里搭系统，希望设备小、线少、上手快"),
    "通用补洞": ("通用系统补洞用户", "已有设备链路中", "补上一个原本缺失但高频需要的小能力", "用户并非追求复杂功能，而是希望用一个小设备填平体验断点"),
}

SOURCE_FEATURE_RULES = (
    ("前级", ("切换前级", "前级", "preamp", "被动前级")),
    ("切换", ("模拟切换器", "数字切换器", "切换器", "切换功能", "ab switch", "switcher", "selector")),
    ("连接", ("家庭音频中枢", "audio hub", "hub", "中枢", "多信源", "接入方案", "avr")),
    ("音量", ("音量", "vu meter", "volume control", "gain")),
    ("音质", ("dac", "benchmark", "spdif", "toslink", "光纤", "数字音频")),
)

SOURCE_SECONDARY_RULES = (
    ("模拟切换更直接", ("模拟切换器", "模拟", "rca", "xlr")),
    ("数字切换更稳定", ("数字切换器", "数字", "toslink", "spdif", "optical", "aes/ebu")),
    ("前级控制更完整", ("切换前级", "前级", "preamp", "被动前级")),
    ("多设备汇总更顺", ("家庭音频中枢", "audio hub", "hub", "中枢", "多信源")),
    ("旧系统接入更顺", ("avr", "receiver", "旧系统", "功放接入")),
)
# hint: features it may be used for
SOURCE_SECONDARY_GUARD = {
    "模拟切换更直接": ("切换",),
    "数字切换更稳定": ("切换",),
    "前级控制更完整": ("前级",),
    "多设备汇总更顺": ("连接", "场景"),
    "旧系统接入更顺": ("连接",),
}

SECONDARY_RULES = {
    "音量": (
        ("音量范围更大", ("louder", "more gain", "gain", "headroom", "output level", "更大音量", "音量不够", "推力", "增益")),
        ("电平匹配更准确", ("level match", "matching", "balance", "电平", "匹配", "平衡")),
        ("静音切换更干净", ("mute", "静音", "pop", "click", "爆音")),
        ("远程调节更方便", ("remote", "遥控", "couch", "sofa")),
    ),
    "音质": (
        ("底噪更低", ("noise", "hum", "buzz", "static", "底噪", "噪音", "电流声")),
        ("失真更少", ("distortion", "clipping", "失真", "削波")),
        ("声音更干净", ("clean", "clear", "transparent", "细节", "解析", "纯净")),
        ("延迟更低", ("latency", "delay", "延迟")),
    ),
    "连接": (
        ("接口覆盖更全", ("xlr", "rca", "toslink", "spdif", "optical", "hdmi", "usb", "6 or 8", "接口", "输入", "输出")),
        ("连接更稳定", ("stable", "intermittent", "drop", "dropout", "接触不良", "间歇", "稳定", "掉线")),
        ("兼容范围更广", ("compatible", "works with", "sample rate", "format", "兼容", "格式", "设备")),
        ("自动识别输入", ("auto", "automatic", "detect", "自动", "识别")),
    ),
    "切换": (
        ("一键切换更直接", ("a/b", "ab", "between", "switch between", "一键", "切换", "切来切去")),
        ("多路路由更清晰", ("2 out", "3 in", "4 in", "multi", "多路", "多输入", "多输出")),
        ("自动切换更聪明", ("auto", "automatic", "自动")),
        ("切换过程更安静", ("pop", "click", "mute", "爆音", "静音")),
    ),
    "前级": (
        ("补上前级控制", ("preamp", "volume", "前级", "音量控制")),
        ("黑胶链路补足前级", ("phono", "turntable", "vinyl", "唱机", "黑胶", "转盘")),
        ("推力或增益更充足", ("gain", "drive", "headphone", "amp", "推力", "增益")),
    ),
    "价格": (
        ("预算内更值", ("worth", "value", "cheap", "price", "性价比", "值", "便宜", "预算")),
        ("低成本替代更稳妥", ("alternative", "instead", "replace", "替代", "平替")),
    ),
    "做工": (
        ("结构更扎实", ("metal", "sturdy", "solid", "结构", "金属", "扎实")),
        ("寿命更长", ("durable", "last", "broken", "stopped working", "耐用", "寿命", "坏了")),
        ("手感更可靠", ("knob", "button", "switch feel", "旋钮", "按钮", "手感")),
    ),
    "外观": (
        ("状态反馈更清楚", ("indicator", "led", "label", "标识", "指示灯", "灯")),
        ("面板更直观", ("design", "look", "appearance", "设计", "外观", "面板")),
    ),
    "体积": (
        ("桌面占用更小", ("compact", "small", "desk", "desktop", "小巧", "紧凑", "桌面")),
        ("部署更省空间", ("setup", "install", "hide", "安装", "布置", "隐藏", "省空间")),
    ),
    "场景": (
        ("组合玩法更灵活", ("works with", "pair with", "route between", "搭配", "组合", "玩法")),
        ("一机多用更顺手", ("use this to", "versatile", "我用它来", "多用", "灵活")),
    ),
}
SECONDARY_BY_FEATURE = {
    "音量": "调节更顺手", "音质": "切换后音质不掉", "连接": "接入更省心", "切换": "切换逻辑更直观",
    "前级": "前级链路更完整", "价格": "预算更可控", "做工": "用久了更放心", "外观": "操作识别更清楚",
    "体积": "摆放更轻松", "场景": "覆盖更多使用法", "基础": "把基础链路补齐",
}
SECONDARY_DEFAULT = "把基础链路补齐"

# ---- fixed values: label sets and scores -------------------------------------

POSITIVE_LABELS = ("惊喜超预期", "顺手便利", "放心省心", "值回票价", "灵感打开", "满意认可")
NEGATIVE_LABELS = ("被噪音打断", "失控难调", "焦虑不确定", "失望落差", "愤怒拒绝", "烦躁麻烦")
NEUTRAL_LABELS = ("理性期待", "理性对比", "观察确认")

AHA_NEEDS = ("降摩擦", "系统补足", "灵感启发", "场景适配")
ORIGINAL_NEEDS = ("灵感启发", "系统补足")

VIEWPOINT_SCORE = {"优点": 2, "抱怨": 3, "建议": 4, "对比": 3, "期望落差": 4, "缺陷复现": 5, "疑似灌水": 1, "观点其他": 1}
POLARITY_SCORE = {"正向": 1, "中性": 0, "负向": 2}
INTENSITY_SCORE = {"轻微": 0, "中等": 1, "强烈": 2}

# ---- fixed values: need layers -----------------------------------------------

LAYERS = ("生理层", "安全层", "归属层", "尊重层", "自我实现层")
LAYER_BY_NEED = {
    "降摩擦": "生理层", "空间效率": "生理层", "连接确定性": "安全层", "控制确定性": "安全层",
    "音质稳定": "安全层", "稳定可靠": "安全层", "系统补足": "归属层", "场景适配": "归属层",
    "性价比安全感": "尊重层", "品质认同": "尊重层", "灵感启发": "自我实现层",
}
LAYER_DEFAULT = "安全层"
LAYER_DESCRIPTIONS = {
    "生理层": "先解决操作负担和空间占用，让系统先能顺手用起来。",
    "安全层": "先保证连接、控制、音质和可靠性，避免用户产生不确定感。",
    "归属层": "让设备真正融入既有系统和使用场景。",
    "尊重层": "让用户觉得这笔投入划算且体面。",
    "自我实现层": "激发新玩法和更高阶的使用想象。",
}
# tried from the top layer down
LAYER_HINTS = (
    ("自我实现层", ("灵感", "启发", "玩法", "diy", "创作", "实验", "探索", "改装", "表达")),
    ("尊重层", ("性价比", "预算", "值", "划算", "高级", "体面", "品质", "认同", "颜值")),
    ("归属层", ("系统", "场景", "客厅", "桌面", "家庭", "融入", "搭配", "补足", "共存", "适配")),
    ("安全层", ("稳定", "可靠", "确定", "兼容", "噪音", "底噪", "失真", "接口", "连接", "控制", "音质", "无声")),
    ("生理层", ("顺手", "方便", "省事", "一键", "切换", "体积", "空间", "省步骤", "摩擦", "部署")),
)

# ---- fixed values: older names of labels -------------------------------------

LEGACY_FEATURES = {
    "音量/控制": "音量", "音质/性能": "音质", "连接/兼容": "连接", "体积/部署": "体积", "做工/耐用": "做工",
    "价格/价值": "价格", "外观/标识": "外观", "前级/放大": "前级", "场景创新/组合玩法": "场景",
    "切换/路由": "切换", "基础功能": "基础",
}
LEGACY_VIEWPOINTS = {"夸张/疑似灌水": "疑似灌水"}
LEGACY_HEADERS = {"功能/主题": "一级功能", "主要功能/主题": "一级功能"}

# ---- fixed values: output headings of the tagged table ------------------------

RECORD_COLUMNS = (
    "record_id", "focus_name", "asin", "product_name", "product_image", "product_link", "thread_url",
    "source_primary_theme", "source_secondary_theme", "source_topic_labels", "scene_name",
    "keyword_source", "source_type", "source_sheet", "source_row", "store", "country", "rating",
    "rating_text", "review_date", "raw_title", "translated_title", "raw_comment", "translated_comment",
    "cleaned_comment", "image_count", "image_refs",
)
TAG_HEADINGS = {
    "viewpoint": "观点类型", "feature": "一级功能", "secondary_need": "二级功能需求", "need": "底层需求",
    "signal": "决策信号", "polarity": "情绪极性", "intensity": "情绪强度", "emotion": "情绪标签",
    "trigger": "情绪触发点", "scene": "场景标签", "persona": "场景人物", "place": "场景地点",
    "motivation": "场景动机", "chain": "场景链路", "aha": "嘿哈时刻", "aha_score": "嘿哈分数",
    "relation": "嘿哈关联度", "originality": "嘿哈独到性", "pain": "痛点机会", "hint": "产品定义启发",
    "analysis": "嘿哈分析", "rank_score": "排序分",
}
