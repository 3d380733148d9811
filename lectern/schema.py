"""Fixed schemas of the stored collections and nested records (Spark DDL)."""

from __future__ import annotations

COLLECTIONS = {
    "users": "id string, name string, email string, role string, is_active boolean, created_at timestamp",
    "notes": (
        "id string, user_id string, title string, file_name string, file_type string, file_size bigint, "
        "content string, summary string, created_at timestamp, updated_at timestamp"
    ),
    "quizzes": (
        "id string, note_id string, user_id string, created_at timestamp, questions array<struct<question:string,"
        "questionType:string,options:array<string>,answer:string,explanation:string>>"
    ),
    "flashcards": (
        "id string, note_id string, user_id string, front string, back string, difficulty string, "
        "review_count int, last_reviewed_at timestamp, created_at timestamp"
    ),
    "chats": (
        "id string, note_id string, user_id string, question string, answer string, tokens_used int, "
        "provider string, created_at timestamp"
    ),
    "audit": (
        "id string, actor_id string, actor_email string, action string, target_type string, target_id string, "
        "metadata string, created_at timestamp"
    ),
    "generation_state": (
        "note_id string, user_id string, stage string, started_at timestamp, completed_at timestamp, "
        "features struct<summary:{s},quiz:{s},flashcards:{s},chatKnowledge:{s}>"
    ).format(
        s="struct<status:string,source:string,confidence:double,aiFallbackUsed:boolean,itemCount:int,"
        "error:string,updatedAt:timestamp>"
    ),
    "results": (
        "note_id string, stage string, failed_stage string, failed_reason string, confidence double, "
        "processed_at timestamp"
    ),
}

QUIZ_DRAFT = (
    "struct<questions:array<struct<question:string,questionType:string,type:string,question_type:string,"
    "options:array<string>,answer:string,explanation:string>>>"
)
CARD_DRAFT = "struct<flashcards:array<struct<front:string,back:string,difficulty:string>>>"
SUMMARY_DRAFT = (
    "struct<overview:string,keyPoints:array<string>,importantConcepts:array<string>,"
    "keyTerms:array<struct<term:string,definition:string>>,unresolvedAssumptions:array<string>>"
)
CLAIM_DRAFT = (
    "struct<claims:array<struct<type:string,subject:string,predicate:string,object:string,metric:string,"
    "numericValue:double,unit:string,evidenceText:string,pageNumber:int,confidence:double>>>"
)
