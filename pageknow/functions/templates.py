"""The eight tasks that every source gets, and where their links come from."""

from __future__ import annotations

from pageknow.operators.planning import Template

# Stages in their order, and the wide table's column of each stage's link.
STAGE_ORDER = {"offer_acceptance": 10, "visa": 20, "housing": 30, "payment": 40, "registration": 50, "orientation": 60}
STAGE_COLUMNS = {
    "offer_acceptance": "offer_holder_url",
    "visa": "visa_url",
    "housing": "accommodation_url",
    "payment": "tuition_url",
    "registration": "admitted_student_url",
    "orientation": "orientation_url",
}

# Code, stage, name, risk, flags that complete it, kinds of links in order of preference, description,
# condition, deadline and documents of each task.
TASKS = (
    Template(
        "accept_offer", "offer_acceptance", "接受 offer 并确认入读意向", "high", ("accepted_offer",), ("offer_acceptance", "offer_holder", "official_website"),
        "登录学校申请系统或 offer letter 指定入口，按要求接受录取。若页面要求同时确认条款、上传回执或选择入学批次，需要一并完成。",
        "收到 offer 后，且尚未完成 official acceptance。",
        "以 offer letter、申请系统或学院邮件显示的 acceptance deadline 为准。",
        "offer letter；申请系统账号；学校要求的接受录取确认信息。",
    ),
    Template(
        "pay_deposit", "offer_acceptance", "缴纳留位费 / admission deposit", "high", ("paid_deposit",), ("offer_holder", "offer_acceptance"),
        "按学校指定付款方式缴纳留位费，并保存付款成功页面、交易编号或银行凭证。",
        "offer 条款或申请系统要求缴纳 deposit，且尚未完成付款。",
        "通常与接受 offer 的截止日绑定；以 offer letter / portal 的金额与截止时间为准。",
        "银行卡或汇款信息；付款凭证；application number / student ID。",
    ),
    Template(
        "submit_conditions", "offer_acceptance", "补交 conditional offer 材料", "high", ("conditions_cleared",), ("admitted_student", "offer_holder"),
        "核对 conditional offer 中尚未满足的条件，提交最终成绩单、毕业证、学位证、语言成绩或官方认证文件。",
        "offer 为 conditional，且仍有 pending condition。",
        "以 conditional offer、学院邮件或学校系统内的 document deadline 为准。",
        "最终成绩单；毕业证 / 学位证；语言成绩；官方认证件；学校额外要求文件。",
    ),
    Template(
        "apply_student_visa", "visa", "申请学生签证 / 进入许可", "high", ("visa_submitted", "visa_approved"), ("visa", "official_website"),
        "内地学生通常需要通过学校申请 entry permit / student visa。尽早准备表格、身份证明、录取证明和资金材料，等待学校或入境处处理。",
        "决定入读且尚未递交学生签证 / 进入许可申请。",
        "以学校签证页面、邮件及香港入境事务处处理周期为准；不要等到临近开学才递交。",
        "签证 / 进入许可申请表；旅行证件；录取证明；财力证明；照片；学校要求的其他文件。",
    ),
    Template(
        "apply_accommodation", "housing", "申请宿舍或安排校外住宿", "medium", ("housing_applied",), ("housing", "accommodation", "official_website"),
        "查询学校住宿申请窗口、资格和优先级；如校内宿舍名额有限，同时准备校外租房备选方案。",
        "计划到港就读，且尚未提交住宿申请或确定住所。",
        "以学校住宿页面公布的 application period / hall application deadline 为准。",
        "student ID / application number；入学证明；住宿申请表；可能需要的紧急联系人信息。",
    ),
    Template(
        "pay_tuition", "payment", "核对并缴纳学费 / 其他费用", "medium", ("tuition_paid",), ("payment", "tuition", "official_website"),
        "核对 programme tuition、缴费方式、分期安排和账单生成时间，按学校财务或学生系统要求付款。",
        "学费账单或缴费通知已发布，且尚未完成付款。",
        "以学校缴费页面、学生系统账单或学院邮件为准。",
        "student ID；缴费通知；付款工具；付款凭证。",
    ),
    Template(
        "complete_registration", "registration", "完成线上注册 / 学籍激活", "high", ("registered",), ("registration", "registration_url", "admitted_student"),
        "按学校注册指引激活学生账号、完成个人资料、上传证件或注册确认，并检查是否需要线下核验。",
        "学校开放 registration / enrolment，且尚未完成。",
        "以学校 registration guide、学生系统和邮件通知为准。",
        "身份证明；旅行证件；证件照片；录取信息；学校要求上传的声明或表格。",
    ),
    Template(
        "prepare_arrival_orientation", "orientation", "准备入境与参加 orientation", "medium", ("orientation_done",), ("orientation", "admitted_student"),
        "整理入境文件、住宿安排、交通和报到材料，关注 orientation / induction 活动报名与时间表。",
        "签证 / 进入许可获批后，或开学前学校发布 orientation 安排。",
        "以学校 orientation 页面、学院邮件和入境日期安排为准。",
        "旅行证件；签证 / 进入许可；录取证明；住宿地址；保险 / 现金 / 电话卡等到港准备材料。",
    ),
)
