"""Explicit schemas of the documents that are read."""

from __future__ import annotations

OPTION = "struct<raw: string, label: string, text: string, full_text: string>"
CORRECT = "struct<raw: string, label: string, text: string, idx: int, full_text: string>"
# frame_idx and raw are unions in the documents, so both are read as JSON text
QUESTION = f"""qid string, qid_flat string, question_category string, template_type string, template_idx int,
  vid_category string, furniture_name string, video_id string, frame_idx string,
  question struct<raw_qstr: string, qstr: string, num_options: int, options: map<string, {OPTION}>,
    correct_option: {CORRECT}>,
  prompt_img_fn string, prompt_img_0_fn string, jumbled_prompt_img_1_fn string, media_dir string, video string"""
RESPONSE = "conv_id string, question string, response string, post_processed_response string"
RLE = "struct<size: array<int>, counts: string>"
MASK_DOCUMENT = f"map<string, map<string, {RLE}>>"
MANIFEST = """original_frame_idx int, subsampled_frame_idx int, timestamp_sec double, is_prompt_frame boolean,
  prompt_frame_idx int, keyframe_idx int, prompt_frame_timestamp_sec double"""
MANIFEST_NULLABLE = ("prompt_frame_idx", "keyframe_idx", "prompt_frame_timestamp_sec")
SOURCE_QUESTION = """question_no string, category string, name string, video_id string, frame_idx array<int>,
  question_category string, template_type string, question_params map<string, array<string>>, kind string,
  options array<array<array<string>>>, correct_idx array<int>, jumble_map map<string, string>,
  part_id_mapping map<string, string>"""
TEMPLATE = "template string, pos int, type string, tag string, content string"
RUN = "run_id string, model_name string, model_key string, setting string, num_shuffles int, seed int"
