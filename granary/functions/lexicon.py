"""Word lists that label legal texts. They are data, in the order in which they are tried."""

from __future__ import annotations

# ---- Fixed values, as text. Order matters: the first list with a hit decides, and in votes earlier domains win ties.

DOMAINS = ("criminal", "civil", "procedural", "general")

#: Names of laws by domain, in the order in which the lists are tried.
LAW_NAMES = {
    "procedural": "民事诉讼法 刑事诉讼法 行政诉讼法 海事诉讼特别程序法 仲裁法 人民调解法 劳动争议调解仲裁法 民事诉讼证据 刑事诉讼规则 办理刑事案件程序规定 适用《中华人民共和国民事诉讼法》 适用《中华人民共和国刑事诉讼法》 适用《中华人民共和国行政诉讼法》 民事诉讼法解释 刑事诉讼法解释 执行程序 诉讼程序 审判程序 强制执行",
    "criminal": "刑法 刑事 反间谍法 反恐怖主义法 禁毒法 监狱法 国家安全法 保守国家秘密法 枪支管理法 预防未成年人犯罪法 关于办理 刑事案件",
    "civil": "民法 民法典 民法总则 民法通则 合同法 物权法 担保法 侵权责任法 婚姻法 继承法 收养法 公司法 合伙企业法 个人独资企业法 企业破产法 破产法 证券法 证券投资基金法 信托法 保险法 票据法 海商法 商标法 专利法 著作权法 反不正当竞争法 反垄断法 消费者权益保护法 产品质量法 食品安全法 劳动法 劳动合同法 社会保险法 土地管理法 城市房地产管理法 农村土地承包法 招标投标法 建筑法 旅游法 电子商务法 电子签名法 建设工程 买卖合同 租赁合同 借款合同 民间借贷 侵权责任 婚姻家庭 继承纠纷 物业服务",
    "general": "宪法 立法法 行政处罚法 行政许可法 行政强制法 行政复议法 治安管理处罚法 道路交通安全法 公务员法 监察法 政府信息公开 地方性法规 行政法规",
}
#: Titles of statutes by domain, in the order in which the lists are tried.
TITLES = {
    "procedural": "诉讼法 刑事诉讼法 民事诉讼法 行政诉讼法 仲裁 调解 程序 执行 证据 监狱 公证 司法鉴定 引渡 管辖",
    "criminal": "刑法 犯罪 刑事 禁毒 反有组织犯罪 反恐怖 反间谍 国家安全 惩戒 刑罚 治安管理处罚",
    "civil": "民法典 民法 物权 合同 婚姻 继承 收养 侵权 担保 公司 企业破产 证券 证券投资基金 保险 票据 海商 信托 期货 专利 商标 著作权 知识产权 反不正当竞争 反垄断 消费者权益 产品质量 劳动 劳动合同 就业 土地承包 农村土地 城市房地产 建筑 招标投标 涉外商事 个人独资 合伙",
}
#: Topics in questions: domain, points for each word, points at most, words.
TOPICS = (
    ("procedural", 0.8, 3.0, "管辖 送达 举证 举证责任 证明标准 时效 上诉 抗诉 再审 申诉 执行 起诉 受理 立案 回避 证据 简易程序 普通程序 独任 合议 审判委员会 诉讼费用 财产保全 先予执行 强制措施 侦查 审查起诉 不起诉 发回重审 开庭 审理期限 延期审理 中止审理 终结诉讼 缺席判决 撤诉 诉讼时效 级别管辖 地域管辖 移送管辖 指定管辖 管辖异议 非法证据排除 取保候审 逮捕 拘留 附带民事诉讼 司法鉴定 勘验 证人出庭"),
    ("criminal", 0.5, 2.0, "犯罪 罪 被告人 定罪 量刑 有期徒刑 拘役 罚金 主犯 从犯 正当防卫 紧急避险 犯罪构成 自首 立功 累犯 数罪并罚 缓刑 假释 追诉 刑事责任 共犯 未遂 既遂 犯罪中止 刑事处罚 罪行 嫌疑"),
    ("civil", 0.5, 2.0, "合同 侵权 赔偿 夫妻 离婚 继承 遗嘱 租赁 借贷 借款 买卖 债务 债权 物权 所有权 抵押 质押 股东 股权 破产 保险 票据 商标 专利 著作权 工伤 房地产 物业 婚姻 抚养 财产分割 违约责任 法人 代理权 个人财产 共同财产 损害赔偿"),
)
#: Kinds of documents, in the order in which they are tried, and their domains.
DOCUMENT_TYPES = (
    ("刑事判决书", "criminal"), ("刑事裁定书", "criminal"), ("刑事附带民事", "criminal"), ("刑事判决", "criminal"), ("民事判决书", "civil"), ("民事裁定书", "civil"),
    ("民事调解书", "civil"), ("民事判决", "civil"), ("商事判决", "civil"), ("行政判决书", "procedural"), ("行政裁定书", "procedural"), ("行政判决", "procedural"),
)
#: Tasks by what they ask for; all others are questions ("qa").
TASK_KINDS = {
    "case_analysis": "jud_doc_sum jud_read_compre leg_ele_extra leg_eve_detec leg_case_cls sim_case_match op_sum judgement_predit sent_pred",
    "exam": "exam judical_examination judical_examination_v2",
    "concept": "crime_concept",
}
#: Tasks that tell a domain.
TASK_HINTS = {"sent_pred": "criminal", "crime_concept": "criminal"}
#: Weights of signals, share of the best from which on a domain is a label, and what procedure counts for in case analysis.
WEIGHTS = {"statute_ref_in_question": 2.0, "statute_ref_in_answer": 1.0, "doc_type": 2.5, "task_hint": 1.5, "crime_concept": 3.0}
LABEL_SHARE, CASE_DISCOUNT = 0.6, 0.35
#: Types of law that are split into articles, standing of laws that is known, and what any other standing becomes.
LAW_TYPES = ("法律", "法律解释", "司法解释", "行政法规")
STANDING, UNKNOWN = ("有效", "已修改", "已废止", "尚未生效"), "未知"
#: Keys of a JSON record whose strings are no text.
SKIPPED_KEYS = ("id", "split", "dimension", "point", "score", "source", "type", "task", "level", "difficulty", "index", "no", "num")
#: Source files and fields by the task that they hold.
FILE_TASKS = {"DISC-Law-SFT-Triplet.json": "judgement_predit", "fakao_gpt4.json": "exam", "zixun_gpt4.json": "legal_advice", "kg_crime_llama.json": "crime_concept"}
SOURCE_TASKS = {
    "judical_examination.json": "judical_examination", "judical_examination_v2.json": "judical_examination_v2", "legal_advice.json": "legal_advice",
    "legal_counsel_with_article_v2.json": "legal_counsel", "legal_counsel_multi_turn_with_article_v2.json": "legal_counsel_multi_turn",
}
#: What refers to the law that a text stands in.
SELF_NOUNS = "法|条例|规定|解释|规则|办法|细则|准则|意见|批复|通知|决定|命令"
NUMERALS = "0-9〇零一二三四五六七八九十百千两"
#: Answers to choice questions: at the head, behind a key word, loose in a short text.
CHOICE_HEAD = r"^[*#\->\s]*([A-Fa-f]{1,6})\s*(?=[:：、,，.。\s]|\z)"
CHOICE_KEY = r"(?:答案|正确选项|应选|选项|选择|正确答案)[^\nA-Fa-f]{0,8}([A-Fa-f]{1,6})"
CHOICE_LOOSE = r"(?<![A-Za-z])([A-F])(?![A-Za-z])"
#: Notes of a version behind a title.
VERSION = r"[（(\[][^（）()\[\]]{0,30}(?:修正|修订|修改|废止)[^（）()\[\]]{0,30}[)）\]]"
