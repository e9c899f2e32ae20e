from stepwell.streaming.requests import answer_requests, request_stream

__all__ = ["answer_requests", "request_stream"]
