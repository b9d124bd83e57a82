"""Constants of the retrieval dataflow (fixed values) and small shared lookups."""

CHUNK_SIZE, CHUNK_OVERLAP, PAGE_SEP = 1000, 150, "\n\n"
BRANCH_TOP_K, RETRIEVAL_TOP_K, SEARCH_TOP_K = 10, 6, 20
MAX_DISTANCE, RRF_K, MMR_LAMBDA = 0.5, 60, 0.7
CONTEXT_BUDGET, STUDIO_BUDGET, SNIPPET_LEN = 6000, 16000, 160
BM25_K1, BM25_B, KEYWORD_ONLY_SCORE = 1.2, 0.75, 0.5
QUESTION_LEN, HISTORY_ITEMS, HISTORY_LEN, HISTORY_TURNS, REWRITE_EXTRA, NAME_LEN = 2000, 50, 20_000, 6, 200, 100
BATCH = 32
DEFAULT_TITLE, NOT_FOUND = "Nguồn", "Không tìm thấy trong nguồn."
REINDEXING = "Đang tái lập chỉ mục nguồn (cập nhật công cụ tìm kiếm cục bộ). Vui lòng thử lại sau giây lát."
STATES = ("queued", "processing", "awaiting_embedding", "ready", "error")
TRANSITIONS = (("queued", "processing"), ("queued", "error"), ("processing", "awaiting_embedding"), ("processing", "ready"), ("processing", "error"), ("awaiting_embedding", "processing"), ("awaiting_embedding", "ready"), ("awaiting_embedding", "error"), ("error", "queued"))

# Extensions, media types and limits in bytes by kind of source.
KINDS = {"pdf": "pdf", "docx": "docx", "txt": "txt", "md": "md", "markdown": "md"} | dict.fromkeys("wav mp3 flac ogg m4a aac".split(), "audio") | dict.fromkeys("mp4 mov webm mkv".split(), "video") | dict.fromkeys("png jpg jpeg webp bmp tiff".split(), "image")
MEDIA_TYPES = {
    "mp3": "audio/mpeg", "wav": "audio/wav", "flac": "audio/flac", "ogg": "audio/ogg", "m4a": "audio/mp4", "aac": "audio/aac", "mp4": "video/mp4", "mov": "video/quicktime", "webm": "video/webm", "mkv": "video/x-matroska",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "bmp": "image/bmp", "tiff": "image/tiff", "gif": "image/gif",
}
SIZE_LIMITS = {k: mb << 20 for k, mb in {"pdf": 50, "docx": 50, "txt": 25, "md": 25, "url": 10, "audio": 200, "video": 1024, "image": 50}.items()}
PALETTE = ("#1E6B57", "#3B6EA5", "#8A5A9E", "#B4713C", "#2F8A6B", "#B4453C", "#6D7A8C", "#C08A2E")
MODEL_VERSION, MODEL_REINDEXING = "e5-small-384", "e5-small-384-reindexing"

# Labels that users see.
STATUS_LABELS = dict(zip(STATES, ("Trong hàng đợi", "Đang xử lý…", "Chờ nhúng", "Sẵn sàng", "Lỗi"), strict=True))
STEP_LABELS = {"parse": "Phân tích", "clean": "Làm sạch", "chunk": "Chia đoạn", "embed": "Nhúng", "store": "Lưu chỉ mục", "done": "Hoàn tất"}
STEP_ERRORS = {"parse": "Lỗi trích xuất", "clean": "Lỗi trích xuất", "chunk": "Lỗi trích xuất", "embed": "Lỗi nhúng", "store": "Lỗi lưu trữ", "done": "Lỗi"}
PAGE_ERROR, SIZE_ERROR, INTERRUPTED = "Lỗi tải trang", "Tệp quá lớn", "Gián đoạn khi nạp — thử lại"
ONLINE_ERRORS = {
    "auth": "Khóa API không hợp lệ hoặc đã hết hạn.", "rate-limit": "Nhà cung cấp đang giới hạn tốc độ, vui lòng thử lại sau.", "timeout": "Máy chủ AI online phản hồi quá lâu (hết thời gian chờ).",
    "network": "Không kết nối được tới máy chủ AI online (kiểm tra mạng).", "server": "Máy chủ AI online gặp lỗi, vui lòng thử lại.", "unknown": "Gọi AI online thất bại.",
}
KIND_ICONS = {"pdf": "PDF", "docx": "DOC", "txt": "TXT", "md": "MD", "url": "WEB", "audio": "AUD", "video": "VID", "image": "IMG"}
KIND_NAMES = {"url": "Web", "audio": "Âm thanh", "video": "Video", "image": "Hình ảnh"}
QUESTION_ERRORS = {"type": "Câu hỏi không hợp lệ.", "empty": "Câu hỏi không được để trống.", "long": f"Câu hỏi quá dài (tối đa {QUESTION_LEN} ký tự).", "mode": "Chế độ trả lời không hợp lệ.", "history": "Lịch sử hội thoại không hợp lệ.", "history-long": "Lịch sử hội thoại quá dài."}
NAME_ERRORS = {"empty": "Tên notebook không được để trống.", "long": f"Tên notebook tối đa {NAME_LEN} ký tự.", "color": "Màu notebook không hợp lệ (phải chọn từ bảng màu).", "id": "Notebook id không hợp lệ."}
SOURCE_ERRORS = {"notebook": "notebookId không hợp lệ.", "origin": "Nguồn thiếu đường dẫn tệp hoặc URL.", "scheme": "Đường dẫn tệp phải là tệp cục bộ (không phải URL)."}
RUNTIME_REASONS = {"down": "Không kết nối được Ollama (kiểm tra Ollama đã cài và đang chạy).", "unset": "Chưa chọn đủ mô hình trả lời và mô hình embedding.", "missing": "Mô hình đã chọn không có trên máy: "}
