"""Fixed values of the data model: tasks, thresholds, feature sets, relation schemas."""

TASKS = ("Data2txt", "QA", "Summary", "XSum")
RANDOM_SEED = 42

# Thresholds that results depend on.
ENTITY_MATCH_THRESHOLD = 0.86
RISK_THRESHOLD = 0.5
CONTAINED_NAME_SIMILARITY = 0.90
ACRONYM_SIMILARITY = 0.92
DENSE_ENTITIES = 20
WINNER_TOLERANCE = 0.05
WINDOW_OVERLAP, WINDOW_MIN_OVERLAP = 0.20, 1

# Features of each task's model, and its inverse regularisation.
FEATURES = {
    "Data2txt": ("weighted_ungrounded_entity_rate", "response_context_entity_ratio", "log_response_relation_count", "fuzzy_novel_endpoint_relation_rate", "fuzzy_ungrounded_entity_rate", "entity_confidence_gap"),
    "QA": ("ungrounded_response_entity_count_log", "min_entity_support_similarity"),
    "Summary": ("mean_entity_support_similarity", "mean_response_entity_confidence"),
    "XSum": ("ungrounded_response_entity_count_log", "novel_endpoint_relation_rate"),
}
REGULARIZATION = {"Data2txt": 10.0, "QA": 0.1, "Summary": 0.1, "XSum": 0.1}
SYMMETRIC_RELATIONS = ("spouse_of",)
RELATION_THRESHOLDS = {"Data2txt": 0.70, "QA": 0.70, "Summary": 0.40, "XSum": 0.30}
EXPECTED_SPLIT_ROWS = {"ragtruth": (10668, 3564, 3558), "xsum": (1196, 388, 408)}
SYSTEM_SCORE_IDS = {"BERTS2S": "bert_withckpt", "TConvS2S": "tconvs2s", "PtGen": "ptgen", "TranS2S": "bert_nockpt"}
ENTITY_LABELS = ("person", "organization", "location", "date or time", "event", "work or product", "role or title", "language", "numeric value", "other named entity")

# Relation ids and the labels shown to models, by task.
RELATIONS = {
    "Data2txt": (
        ("part_of", "part of"),
        ("located_in", "located in"),
        ("capital_of", "capital of"),
        ("born_in", "born in"),
        ("died_in", "died in"),
        ("citizen_of", "citizen of"),
        ("date_of_birth", "date of birth"),
        ("date_of_death", "date of death"),
        ("started_on", "started on"),
        ("ended_on", "ended on"),
        ("occurred_on", "occurred on"),
        ("member_of", "member of"),
        ("employed_by", "employed by"),
        ("educated_at", "educated at"),
        ("holds_role_in", "holds role in"),
        ("founded", "founded"),
        ("owns", "owns"),
        ("acquired", "acquired"),
        ("operates", "operates"),
        ("parent_of", "parent of"),
        ("spouse_of", "spouse of"),
        ("created", "created"),
        ("published", "published"),
        ("uses_language", "uses language"),
        ("participated_in", "participated in"),
        ("won", "won"),
        ("defeated", "defeated"),
        ("supports", "supports"),
        ("opposes", "opposes"),
        ("causes", "causes"),
    ),
    "QA": (
        ("located_in", "entity is located in place"),
        ("part_of", "component is part of whole"),
        ("made_of", "object is made of material"),
        ("has_property", "entity has a non-numeric property, state, amenity, or evaluation"),
        ("has_value", "entity has a numeric, monetary, rating, or measured value"),
        ("used_for", "item or method is used for purpose"),
        ("requires", "action or process requires a condition, input, or prerequisite"),
        ("causes", "cause produces outcome"),
        ("prevents", "action prevents outcome"),
        ("increases", "factor increases quantity or state"),
        ("decreases", "factor decreases quantity or state"),
        ("depends_on", "quantity or state depends on factor"),
        ("exceeds", "first entity is greater, higher, larger, faster, or more than second"),
        ("applies_to", "rule or policy applies to group or case"),
        ("permits", "rule or system permits action"),
        ("procedure_step", "procedure includes step"),
        ("uses_parameter", "action uses a tool, material, setting, order, or duration"),
        ("treats", "treatment treats condition"),
        ("supported_by_document", "claim is supported or mentioned by document"),
        ("unsupported_by_document", "claim is absent or unsupported by document"),
        ("occurs_at", "event occurs at time"),
        ("experiences", "entity undergoes an event or incident"),
        ("communicates", "source states, reports, announces, predicts, warns, or discusses claim"),
        ("should_do", "actor should or is recommended to perform action"),
        ("risk_or_exposure", "entity faces risk or exposure from hazard or outcome"),
    ),
    "Summary": (
        ("located_in", "entity is located in place"),
        ("part_of", "component is part of whole"),
        ("has_property", "entity has a non-numeric property, state, amenity, or evaluation"),
        ("has_value", "entity has a numeric, monetary, rating, or measured value"),
        ("has_count", "entity has a count"),
        ("offers", "provider offers or performs an item, service, or process"),
        ("causes", "cause produces outcome"),
        ("decreases", "factor decreases quantity or state"),
        ("forbids", "authority or rule forbids action or denies a right"),
        ("occurs_at", "event occurs at time"),
        ("experiences", "entity undergoes an event or incident"),
        ("communicates", "source states, reports, announces, predicts, warns, or discusses claim"),
        ("plans", "actor intends or plans a future action"),
        ("holds_role", "person holds role or position in organization"),
        ("arrests", "authority arrests person"),
        ("charges", "authority charges person with offense"),
        ("convicts", "court convicts person of offense"),
        ("challenges", "actor challenges or appeals person, action, or decision"),
        ("enacts_policy", "institution passes, waives, or changes law or policy"),
        ("attacks", "actor attacks target"),
        ("kills", "actor kills person"),
        ("captures", "actor captures place or target"),
        ("wins", "participant wins competition, award, election, or legal victory"),
        ("risk_or_exposure", "entity faces risk or exposure from hazard or outcome"),
        ("pays_for", "actor pays for item or service"),
        ("parent_of", "person is parent of person"),
        ("born_in", "person is born in place"),
        ("dies_in", "person dies in place"),
        ("moves_to", "entity moves toward or to place"),
        ("resolves", "actor resolves dispute or problem"),
        ("creates", "creator creates, launches, produces, or photographs work or product"),
        ("supports", "actor supports proposal, policy, claim, or person"),
        ("opposes", "actor opposes proposal, policy, claim, or person"),
    ),
    "XSum": (
        ("located_in", "entity is located in place"),
        ("has_value", "entity has a numeric, monetary, rating, or measured value"),
        ("decreases", "factor decreases quantity or state"),
        ("forbids", "authority or rule forbids action or denies a right"),
        ("experiences", "entity undergoes an event or incident"),
        ("communicates", "source states, reports, announces, predicts, warns, or discusses claim"),
        ("plans", "actor intends or plans a future action"),
        ("holds_role", "person holds role or position in organization"),
        ("member_of", "person or organization is member of organization"),
        ("recruits", "organization recruits or signs person"),
        ("resigns", "person resigns or leaves role or organization"),
        ("arrests", "authority arrests person"),
        ("charges", "authority charges person with offense"),
        ("challenges", "actor challenges or appeals person, action, or decision"),
        ("kills", "actor kills person"),
        ("wins", "participant wins competition, award, election, or legal victory"),
        ("scores", "player scores goal or point"),
        ("draws", "team draws with team"),
        ("plays_against", "team or participant plays against opponent"),
        ("risk_or_exposure", "entity faces risk or exposure from hazard or outcome"),
        ("moves_to", "entity moves toward or to place"),
        ("resolves", "actor resolves dispute or problem"),
        ("creates", "creator creates, launches, produces, or photographs work or product"),
    ),
}
