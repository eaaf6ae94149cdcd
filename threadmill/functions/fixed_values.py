"""Labels, reasons, patterns and limits that results depend on. They are data, kept together and in order."""

CLOSURE_LABELS = ("resolved", "uncertain", "unresolved")
DECISIONS = ("auto", "escalate")

REASONS = {
    "customer_continues": "customer keeps asking after the brand's last reply",
    "customer_resolved": "customer's final message acknowledges the issue is resolved",
    "customer_dm": "customer moved the conversation to DMs; the outcome is not visible here",
    "customer_dm_ack": "customer acknowledged the brand after it moved the conversation to DMs; the outcome is not visible here",
    "customer_unclear": "customer's final message neither acknowledges nor continues the issue",
    "brand_completion": "brand's final reply confirms the issue was handled",
    "brand_refusal": "brand's final reply says it cannot help",
    "brand_ack_close": "customer acknowledged the brand's help before its closing reply",
    "brand_dm": "brand moved the conversation to DMs; the outcome is not visible here",
    "brand_question": "brand asked for more information and the customer did not reply",
    "brand_followup": "brand promised to investigate further and the customer did not reply",
    "brand_silence": "brand replied and the customer went silent",
}
FLAGS = ("customer_dm", "customer_dm_ack", "customer_unclear", "brand_dm")

URL = r"https?://\S+|t\.co/\S+"
MENTION = r"@\w+"
APOSTROPHES = "’‘`´"
ACK_LENGTH = 72

PATTERNS = {
    "fixed": r"(\b(?:fixed|solved)\b|works? (?:now|perfectly|fine|again)|working (?:now|perfectly|fine|again)|that (?:worked|did it|fixed it)|it'?s working|it works|back to normal|all good now|no issues? now)",
    "negated_fix": r"\b(?:not|never|isn'?t|wasn'?t|weren'?t|hasn'?t|hadn'?t|ain'?t)\b(?: been| yet| even| fully| properly| completely| really| quite)* (?:fixed|solved|resolved)",
    "ack": r"(\bthanks?\b|\bthank you\b|\bthx\b|\bty\b|\bcheers\b|\bappreciate (?:it|your|the)\b|\bgot it\b|\bgotcha\b|\bperfect\b|\bawesome\b|\blovely\b|\bthat'?s great\b|\ball good\b|\bsorted\b|\bbutiful\b|worked, thank)",
    "continuation": r"(\?|not work|doesn'?t work|didn'?t work|any update|any news|any chance|when will|how long|how many|same (?:issue|problem)|nothing (?:happened|changed)|yet to|waiting|waited|no (?:reply|response|answer|one)|please (?:help|fix|reply|respond)|help me|can'?t (?:log|sign|access|play|use|find|see|get)|cannot (?:log|sign|access|play|use|find|see|get)|still (?:can'?t|cannot|not|no |never |waiting|broken|broke|crash(?:es|ing|ed)?|having|down|happening|gone|the same|an issue|a problem)|i (?:have|'?ve got|got) (?:an? )?(?:issue|problem)|the (?:issue|problem) (?:is|persists|remains)|not (?:sure|solved|resolved)|but not|not (?:for|on|with) me|only works|works only|\bexcept\b|where is|why (?:is|are|doesn'?t|did)|what about|need (?:help|this)|give me)",
    "dm_reply": r"(^\W*(?:dmed|dm'?d|dm'?ed)\b|\bi (?:have |just |already )?(?:dmed|dm'?d|dm'?ed|messaged|sent)\b|sent .{0,20}\bdms?\b|replied .{0,20}\bdms?\b|\bdms?\b .{0,20}\b(?:sent|done|replied)\b|slid into (?:your|the) dms?\b|messaged you\b|dm sent\b)",
    "completion": r"(we'?ve (?:fixed|resolved|processed|updated|sorted|taken care)|has been (?:fixed|resolved|processed|updated)|is now (?:fixed|resolved|working|available)|should (?:now )?(?:be )?(?:working|work|be fixed|be resolved)|you'?re all set|back to normal|back (?:up and running|on track)|it'?s fixed)",
    "soft_invite": r"(if you (?:ever )?(?:need|have)|anything else|give us a shout|you know where to find us|we'?re (?:here|around)|just let us know|shout if|reach out (?:if|anytime)|don'?t hesitate)",
    "thanks_anyway": r"thanks? (?:anyway|anyways)",
    "refusal": r"(unfortunately|we'?re afraid|we (?:can'?t|cannot|won'?t)(?! (?:wait|thank|recommend))|i'?m afraid|we (?:currently )?(?:do not|don'?t) (?:currently )?(?:have|offer|support)(?: any)?|not available|unable to|not something we|outside of our|not possible|we'?re not able|isn'?t (?:something|available))",
    "deflection": r"(\bdms?\b|direct message|sent you a (?:bit more info over )?dm|sent a dm|replied to your dm|check your dm|carry on (?:chatting|helping)? ?(?:there|in dm)|carry on there|continue (?:chatting|helping|the conversation)? ?(?:there|via dm|in dm)|message us|shoot us a dm|send us a dm|via dm|over dm|slide into our dm|dm'?d you|we'?ll dm|dm me)",
    "question": r"(\?\s*$|\? |can you|could you|would you|let us know|send us|shoot us|fire over|share (?:the|your)|confirm|tell us|try (?:again|to)|give it another)",
    "followup": r"(we'?ll (?:take a look|check|look into|see what|get back|follow up|investigate|pass|share|let|make sure|get .{0,20}passed)|pass(?:ed)? (?:this|it|your .{0,20})? ?(?:on |onto )?to the (?:right )?team|make sure to (?:pass|share|let)|let the right (?:team|folks) know|we'?ll keep (?:you (?:posted|updated)|(?:an? )?(?:eye|ear))|our team is|we are (?:looking|investigating))",
}

#: Ordered keyword rules of the answer page: pattern, intent, confidence, evidence, decision.
KEYWORD_RULES = (
    (r"(hack|hacked|password|login|log ?in|sign ?in|locked out|credentials)", "account", 0.93, ("case_2779503", "case_1819027"), "escalate"),
    (r"(charg|payment|refund|billing|invoice|card|paypal|gift card|receipt)", "billing_payment", 0.88, ("case_367624", "case_2647464"), "escalate"),
    (r"(play|song|shuffle|queue|skip|volume|error.*play|can't play)", "playback", 0.87, ("case_2920760", "case_1840273"), "auto"),
    (r"(presale|pre-sale|presell|concert.*code|tour.*code)", "presale_codes", 0.95, ("case_2150438", "case_2203840"), "auto"),
    (r"(family|invite|member.*plan|join.*family)", "family_plan", 0.84, ("case_2978154", "case_1846413"), "auto"),
)
KEYWORD_FALLBACK = ("app_technical", 0.62, ("case_1516306", "case_2395935"), "escalate")

#: Reply and reason that go with each intent of the keyword rules.
KEYWORD_REPLIES = {
    "account": (
        "Thanks for flagging this — I can see this looks like an account access issue. For your safety, please reset your password from the login page and sign out of all devices. A human specialist will follow up here to confirm your account is secure.",
        "High-risk category (security/credentials) — always escalates regardless of confidence.",
    ),
    "billing_payment": (
        "Sorry about the billing trouble. Similar past cases were resolved by checking the receipt on the account page and retrying the payment method. A human specialist will review the charge details with you here.",
        "Payment dispute — requires account-specific investigation before auto-handling.",
    ),
    "playback": (
        "Sorry your music is not playing. Try a quick restart of the app, then check for updates — that resolved similar playback cases. If the error persists, let us know what device you are on.",
        "High intent confidence with strong historical evidence; no high-risk signals.",
    ),
    "presale_codes": (
        "Presale codes are sent to the email on your account before the sale window. Check spam/promotions and the concert page — that is where similar cases found the code.",
        "High intent confidence with strong historical evidence; no high-risk signals.",
    ),
    "family_plan": (
        "Sorry the Family invite is failing. Ask the plan owner to resend the invite link and make sure everyone uses the same country on their accounts — that fixed similar cases.",
        "High intent confidence with strong historical evidence; no high-risk signals.",
    ),
    "app_technical": (
        "Thanks for reaching out — this looks like it may be an app issue. Try updating to the latest version and restarting your device. A human specialist will take a look to confirm the next step.",
        "Intent confidence is below the auto-handle threshold, so this needs human review.",
    ),
}

SAMPLE_SIZE, HOLDOUT_SIZE, SEED = 4000, 1000, 42
CLUSTERS, EXAMPLES, CANDIDATES, DECIMALS, TOP_K = 30, 8, 5, 6, 5
GOLDEN_TARGET, GOLDEN_FLOOR, AUTO_SHARE = 200, 10, 0.6
DEV_SLICE, REVIEW_EXAMPLES = 500, 5
TAXONOMY_SIZES = (8, 15)
MIN_LANGUAGE_DISTANCE = 0.25
