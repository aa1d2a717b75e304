"""quarrylight.functions"""
