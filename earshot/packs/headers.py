"""Header names by which loosely labelled sheets are recognised.

Fixed values: (semantic, aliases).  The weight of a semantic says how much a
match counts when the header row is searched.
"""

# ---- fixed values: review workbooks -------------------------------------------

REVIEW_ALIASES = {
    "asin": ("asin", "sku id", "商品id", "listing asin"),
    "product_name": ("产品", "产品名", "商品标题", "商品名称", "product_name", "listing title", "product title", "product", "sku", "型号", "机型"),
    "product_image": ("商品图片", "product image", "image url", "主图", "主图链接", "cover image"),
    "product_link": ("商品链接", "product link", "listing url", "url", "link"),
    "thread_url": ("thread_url", "thread url", "讨论链接", "帖子链接"),
    "source_primary_theme": ("primary_theme", "primary theme", "一级功", "一级功能", "主话题"),
    "source_secondary_theme": ("secondary_themes", "secondary_theme", "secondary themes", "二级功", "二级功能", "二级话题"),
    "source_topic_labels": ("topic_labels", "topic label", "topic labels", "话题标签", "标签"),
    "scene_name": ("场景名称", "场景", "scene", "use case", "usage scene"),
    "keyword_source": ("关键词来源", "关键词", "keyword", "search keyword", "query"),
    "store": ("店铺", "store", "shop", "seller", "merchant"),
    "country": ("国家", "country", "market", "站点"),
    "rating": ("评分", "rating", "stars", "星级", "score"),
    "rating_text": ("评分文本", "rating text"),
    "review_date": ("评论时间", "日期", "date", "time", "review date", "post_date"),
    "raw_title": ("评论标题", "review title", "headline", "标题", "thread_title"),
    "translated_title": ("评论标题中文", "标题中文", "translated title", "title cn"),
    "raw_comment": ("评论内容", "原文", "英文评论", "review", "comment", "review text", "comment text", "body", "post_text", "raw_text", "买家备注"),
    "translated_comment": ("评论内容中文", "中文翻译", "翻译", "译文", "comment cn", "review cn"),
    "image_count": ("图片数量", "image count", "photo count", "image num", "image_count"),
}
REVIEW_WEIGHTS = {"raw_comment": 2, "translated_comment": 2, "product_name": 2}
REVIEW_SCAN_ROWS = 8

IMAGE_HEADER = r"^(图片\d+|image\d+|photo\d+|image_urls?)$"
IMAGE_HEADER_NAMES = ("图片路径", "图片目录", "imagepath", "photo")

# ---- fixed values: return and after-sales workbooks ----------------------------

RETURN_ALIASES = {
    "product_name": ("sku", "产品", "产品名", "product", "model", "型号", "机型"),
    "store": ("店铺", "store", "shop"),
    "country": ("国家", "country"),
    "raw_comment": ("原文", "英文评论", "comment", "review", "买家备注", "buyer note", "buyer remark"),
    "translated_comment": ("中文翻译", "翻译", "中文", "translation"),
    "return_reason": ("退货原因", "reason", "return reason"),
    "return_time": ("退货时间", "return time", "return date", "refund date"),
    "source_row_id": ("原始行号", "row id", "source row"),
    "order_id": ("订单号", "order id"),
    "level_1": ("一级分类", "问题分类：1级", "分类", "人工标签"),
    "level_2": ("二级分类", "问题分类：2级", "二级分类（人工）", "细分"),
    "level_3": ("三级问题点", "三级分类", "问题分类：3级"),
    "level_4": ("四级归因",),
}
RETURN_WEIGHTS = {"level_1": 2, "level_2": 2, "level_3": 2, "level_4": 2}
RETURN_SCAN_ROWS = 6
