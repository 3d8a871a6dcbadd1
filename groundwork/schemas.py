"""Schemas of the tables read and written."""

ENTITY = "struct<start:int,end:int,text:string,label:string,score:double>"
RELATION = "struct<head_start:int,head_end:int,head_text:string,tail_start:int,tail_end:int,tail_text:string,relation_id:string,score:double>"
GRAPH = f"struct<entities:array<{ENTITY}>,relations:array<{RELATION}>>"
GRAPH_PAIR = f"sample_id string, task_type string, context_graph {GRAPH}, response_graph {GRAPH}"
SAMPLE = "sample_id string, source_id string, task_type string, context string, query string, response string, generator_model string, hallucinated int"
TEXTS = "sample_id string, task_type string, context string, response string"
ENTITY_CACHE = "k string, e array<string>, t double"
MANIFEST = "version int, datasets map<string,struct<source_count:int,source_ids_sha256:string,validation:array<string>,test:array<string>>>"
RESPONSES = "id string, source_id string, response string, model string, quality string, split string, labels array<struct<implicit_true:boolean>>"
